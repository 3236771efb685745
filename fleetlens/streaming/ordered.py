"""Rows of a key in the order of their times, however they arrive within the watermark.

A row waits in the state until the watermark has passed its time; then no earlier row can come any more. The waiting rows
that are ripe are handed on in order, together with the small value that the rows of their key before them left behind.

Every call to the state goes from Python to the JVM and back, so rows wait in groups of many keys: one call stores what a
batch brings to a group, as packed rows, one reads it, one timer wakes it. What a key left behind is an entry of its own, so only keys with
ripe rows are read and written. The state holds the rows of one delay, not the history.
"""

from __future__ import annotations

import pickle
import sys
from collections.abc import Callable, Iterator, Sequence

from pyspark import cloudpickle
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import BinaryType, LongType, StructField, StructType

# executors need no copy of this package
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Microseconds since 1970, which is what rows are ordered by.
AT = "_at"


#: Keys are dealt over so many groups. A run's state keeps the number it has started with.
GROUPS = 1024
GROUP = "_group"
#: Rows that are stored as one value.
PACKED = 10_000


def _packed(rows: list[tuple]) -> list[tuple]:
    return [(pickle.dumps(rows[i:i + PACKED]),) for i in range(0, len(rows), PACKED)]


class InOrder(StatefulProcessor):
    """Calls `step(carry, row)` for each ripe row of a key, which gives the key's next carry and an output row or None.

    `order` gives what rows of one key are sorted by; it starts with the time. A key whose last row is `keep_ms` behind
    the watermark is forgotten.
    """

    def __init__(self, rows: StructType, keys: StructType, carry: StructType, output: list[str], order: Callable, step: Callable, keep_ms: int | None):
        self.rows, self.keys, self.output, self.order, self.step, self.keep_ms = rows, keys, output, order, step, keep_ms
        self.carries = StructType([*carry.fields, StructField("_seen", LongType())])

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.row = Row(*self.output)
        self.waiting = handle.getListState("waiting", StructType([StructField("rows", BinaryType())]))
        self.carry = handle.getMapState("carry", self.keys, self.carries)
        self.sweep = handle.getValueState("sweep", StructType([StructField("at", LongType())]))

    def _wake(self, at: int) -> None:
        self.handle.registerTimer(-(-at // 1000))

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        names, new, places = [*self.rows.names, *self.keys.names], [], None
        for r in rows:
            if places is None:
                places = [r.__fields__.index(n) for n in names]
            new.append(tuple([r[i] for i in places]))
        if new:
            self.waiting.appendList(_packed(new))
            self._wake(min(r[0] for r in new))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        now = timerValues.getCurrentWatermarkInMs() * 1000
        width = len(self.rows)
        ripe, rest = {}, []
        if self.waiting.exists():
            for value in self.waiting.get():
                for r in pickle.loads(value[0]):
                    if r[0] <= now:
                        # by its text, as arrays cannot be hashed and no NaN equals another
                        ripe.setdefault(repr(r[width:]), (r[width:], []))[1].append(r[:width])
                    else:
                        rest.append(r)
        if ripe:
            yield from self._handed_on(ripe)
            if rest:
                self.waiting.put(_packed(rest))
                self._wake(min(r[0] for r in rest))
            else:
                self.waiting.clear()
        if self.keep_ms is not None:
            self._forget(now)

    def _handed_on(self, ripe: dict) -> Iterator[Row]:
        known = self.carry.exists()
        for k, rows in ripe.values():
            rows.sort(key=self.order)
            left = self.carry.getValue(k) if known else None
            carry, before = (None, None) if left is None else (tuple(left[:-1]), left[-1])
            for r in rows:
                # a pause longer than is kept counts as forgotten, also where both rows ripen at once
                if self.keep_ms is not None and before is not None and r[0] - before > self.keep_ms * 1000:
                    carry = None
                carry, out = self.step(carry, r)
                before = r[0]
                if out is not None:
                    yield self.row(*k, *out)
            if carry is not None:
                self.carry.updateValue(k, (*carry, before))

    def _forget(self, now: int) -> None:
        """Drop the keys that have been silent for as long as is kept; a group looks for them once such a time."""
        due = self.sweep.get()[0] if self.sweep.exists() else None
        if due is not None and due > now:
            return
        # the last rows of keys, and until when they are kept
        ends = [(k, v[-1] + self.keep_ms * 1000) for k, v in self.carry.iterator()]
        for k, end in ends:
            if end <= now:
                self.carry.removeKey(k)
        left = [end for _, end in ends if end > now]
        if left:
            due = min(left)
            self.sweep.update((due,))
            self._wake(due)
        elif due is not None:
            self.sweep.clear()


def in_order(stream: DataFrame, keys: Sequence[str], time: str, columns: Sequence[str], carry: StructType, output: StructType,
             order: Callable, step: Callable, keep_ms: int | None = None) -> DataFrame:
    """keys, `_at` and the columns of `output`, for each row of a stream that has a watermark on `time`.

    `step` and `order` get a row as a tuple: the time in microseconds, then `columns`.
    """
    keys = list(keys)
    # null-safe: null keys hash alike
    group = F.pmod(F.xxhash64(*keys), F.lit(GROUPS)).alias(GROUP)
    rows = stream.select(group, *keys, time, F.unix_micros(time).alias(AT), *columns)
    kinds = {f.name: f for f in rows.schema.fields}
    stored = StructType([StructField(n, kinds[n].dataType, True) for n in (AT, *columns)])
    named = StructType([StructField(k, kinds[k].dataType, True) for k in keys])
    full = StructType([*named.fields, *output.fields])
    processor = InOrder(stored, named, carry, full.names, order, step, keep_ms)
    return rows.groupBy(GROUP).transformWithState(processor, full, "Append", "EventTime")
