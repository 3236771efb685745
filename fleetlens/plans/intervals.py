"""Joins on overlapping time intervals.

An interval's level is the smallest number whose power of two is at least its length, so at its own level it touches two
bins at most, however long it is. Of two intervals that overlap, the longer one's level is the higher: there it
lies in its own bins, and the shorter one touches two at most. So every interval is put into its own level, and looks
into the bins of all higher levels that the other side has; both sides do so, and level equality goes to one of them. A
pair that meets in two bins counts in the one where the later of the two begins. Rows are multiplied by the number
of levels (a handful), never by the number of bins an interval spans, and what shares a bin is close to overlapping.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetlens.functions.columns import micros
from fleetlens.plans.joins import join_null_safe
from fleetlens.plans.sequences import with_next

#: Levels from a microsecond to more than 290,000 years.
HIGHEST = 62
OPEN_END = (1 << HIGHEST) - 1


def changes_as_intervals(changes: DataFrame, keys: Sequence[str], time: str, bucket: Column, end: str = "valid_until") -> DataFrame:
    """Every change with the time of the key's next one, null for the last; changes at one moment are one interval each,
    all but the last of them empty."""
    rest = [x for x in changes.columns if x not in keys and x != time]
    return with_next(changes, keys, [time, *rest], [time], bucket).withColumnRenamed(f"next_{time}", end)


def _sided(df: DataFrame, keys: list[str], start: str, end: str, inclusive: bool) -> DataFrame:
    begin = micros(F.col(start))
    stop = F.coalesce(micros(F.col(end)), F.lit(OPEN_END)) - (0 if inclusive else 1)
    level = F.when(stop <= begin, 0).otherwise(F.least(F.length(F.bin(stop - begin)), F.lit(HIGHEST)))
    rest = [c for c in df.columns if c not in keys]
    return df.select(*keys, F.struct(*[F.col(f"`{c}`") for c in rest]).alias("row"), begin.alias("begin"), stop.alias("stop"), level.cast("int").alias("level")).where("begin <= stop")


def _levels(df: DataFrame) -> list[int]:
    return sorted(r[0] for r in df.select("level").distinct().collect())  # at most HIGHEST + 1


def _in_bins(df: DataFrame, level: Column) -> DataFrame:
    """A row for each bin (two at most) that the interval touches at a level that is at least its own."""
    first, last = F.expr("shiftright(begin, at)"), F.expr("shiftright(stop, at)")
    return df.withColumn("at", level).withColumn("slot", F.explode(F.array_distinct(F.array(first, last))))


def overlap_join(left: DataFrame, right: DataFrame, keys: Sequence[str], left_interval: tuple[str, str], right_interval: tuple[str, str],
                 left_inclusive: bool = False, right_inclusive: bool = False, prefix: str = "other_") -> DataFrame:
    """Pairs of rows with equal `keys` (null meets null) whose intervals share a moment.

    Intervals are given by two columns of zone-free times, the end exclusive unless said otherwise; a null end is open,
    a null begin or an end before the begin is no interval. The right side's columns but the keys get the `prefix`.
    """
    keys = list(keys)
    a = _sided(left, keys, *left_interval, left_inclusive)
    b = _sided(right, keys, *right_interval, right_inclusive)
    posted = _joined(a, b, keys, _levels(a), same_level=True)
    probed = _joined(b, a, keys, _levels(b), same_level=False)
    pairs = posted.unionByName(probed.select(*keys, F.col("probe").alias("post"), F.col("post").alias("probe")))
    l_rest, r_rest = [c for c in left.columns if c not in keys], [c for c in right.columns if c not in keys]
    return pairs.select(*keys, *[F.col("post").getField(c).alias(c) for c in l_rest], *[F.col("probe").getField(c).alias(prefix + c) for c in r_rest])


def _joined(long: DataFrame, short: DataFrame, keys: list[str], levels: list[int], same_level: bool) -> DataFrame:
    """Pairs (post, probe): intervals of `long` in bins of their own level, those of `short` of no higher one in the same bins."""
    post = _in_bins(long, F.col("level")).select(*keys, "at", "slot", F.col("row").alias("post"), F.col("begin").alias("l_begin"), F.col("stop").alias("l_stop"))
    higher = F.filter(F.array(*[F.lit(x) for x in levels]).cast("array<int>"), lambda x: x >= F.col("level") if same_level else x > F.col("level"))
    spread = short.withColumn("to", F.explode(higher))
    probe = _in_bins(spread, F.col("to")).select(*keys, "at", "slot", F.col("row").alias("probe"), F.col("begin").alias("s_begin"), F.col("stop").alias("s_stop"))
    # the rows of a bin are exploded ones, which the optimiser does not count
    met = join_null_safe(post, probe, [*keys, "at", "slot"], grown=True)
    return met.where("l_begin <= s_stop AND s_begin <= l_stop AND slot = shiftright(greatest(l_begin, s_begin), at)").select(*keys, "post", "probe")


def state_by_intervals(samples: DataFrame, changes: DataFrame, keys: Sequence[str], time: str, state: Sequence[str], bucket: Column) -> DataFrame:
    """Each sample with the state valid at its time: the range-join form of `sequences.state_as_of`.

    A sample is an interval of one moment. Every key of the samples starts with an interval without a state, so each
    sample lies in exactly one; samples without a time have none and keep nulls.
    """
    keys, state = list(keys), list(state)
    kinds = {f.name: f.dataType for f in changes.schema.fields}
    start = samples.select(*keys).distinct().select(*keys, F.lit("0001-01-01 00:00:00").cast("timestamp_ntz").alias(time), *[F.lit(None).cast(kinds[c]).alias(c) for c in state])
    valid = changes_as_intervals(changes.select(*keys, time, *state).unionByName(start), keys, time, bucket).withColumnRenamed(time, "valid_from")
    found = overlap_join(samples.where(F.col(time).isNotNull()), valid, keys, (time, time), ("valid_from", "valid_until"), left_inclusive=True, prefix="_state_")
    timeless = samples.where(F.col(time).isNull())
    return found.select(*samples.columns, *[F.col(f"_state_{c}").alias(c) for c in state]).unionByName(timeless, allowMissingColumns=True)
