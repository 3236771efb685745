"""Approximate nearest neighbours by NN-descent and greedy graph search.

The index is a graph with the `degree` nearest vectors found so far of every vector. It starts from blocks: vectors are
sorted by the nearest of some pivots (a bounded sample) and a hash; up to 10,000 that follow each other are halved along
random directions down to blocks of at most 1,024, twice, and each looks at the others of its blocks. That is done for
several sets of pivots. Every iteration then lets the neighbours of a vector meet: an edge goes to both its ends, and at
each end all members compare with each other if one of the two is new there; what beats the worst neighbour of either is
handed to it. Iterations end when at most a share `changed` of all edges is new. A vector that very many have as neighbour takes a hash sample of them, as many as it has itself,
so no vector gathers an unbounded group; the others still meet it through their own lists.

Graph and search compare the vectors as they are given (floats or doubles, not codes of them), so near copies keep their
order and a few long vectors change nothing for the others. A query is a row itself; it starts from its own neighbours in the graph and expands what is not expanded yet among the `beam` nearest vectors it has
seen, until all of these are expanded.

Vectors have homes: parts of some thousand vectors each, by pivot and hash. An address names part and row. All steps are exchanges of
arrays between parts (rows of `PACK`): a part gets each vector that its lists need once, whatever the number of lists, and a
query goes once a round to each part that holds some of its candidates.

Equal vectors are one node; the answer names up to `k` of their smallest ids.

Defined results: vectors that are null, empty, zero, of another length than most, or have a null or non-finite component
take no part, as rows or as queries. Fewer candidates than `k` are all returned. Rows without an id take no part; rows
that share an id and a vector are one, with different vectors each counts. Ties go to the smaller id.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetlens.llm.storage import discard, release, settled

PIVOTS = 64
BLOCK = 1024
#: Sets of pivots, and ways to halve what they bring together.
STARTS = 4
TREES = 2
#: Of the squared lengths; more than the rounding of a distance by products.
ROUNDING = 1e-12
#: Of the squared lengths; distances below are formed anew from differences.
CLOSE = 1e-6
#: Pairs whose differences are formed at once.
PART = 20_000
#: Centers whose members meet at once.
SLAB = 128
#: Distances that a task holds before it hands lists on.
HELD = 2_000_000
#: Bytes of the vectors that a part's lists may need, and parts that share small inputs.
SEATS = 48_000_000
FEW = 12
#: Bytes that go to Spark at once.
AT_ONCE = 16_000_000

#: An exchange between parts: arrays as bytes, of one kind.
PACK = "part int, kind int, src int, a binary, b binary, c binary, d binary, e binary, f binary"
FIELDS = pa.schema([("part", pa.int32()), ("kind", pa.int32()), ("src", pa.int32()), *((x, pa.binary()) for x in "abcdef")])
VECTORS, LISTS, BACK, MEMBERS, WANTED, SEATED, FOUND, LINKS, ASKING, EXPAND, LINKED, MEASURE, MEASURED, NAMED = range(14)


def usable(vector: Column) -> Column:
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vector.isNotNull() & (F.size(vector) > 0) & ~bad & F.exists(vector, lambda x: x != 0)


def _flat(column: pa.Array) -> np.ndarray:
    """Lists of one length as the rows of a matrix."""
    n = len(column)
    return column.flatten().to_numpy(zero_copy_only=False).reshape(n, -1) if n else np.zeros((0, 1))


def _array(buffer: pa.Buffer | None, kind: str) -> np.ndarray:
    return np.frombuffer(buffer, kind) if buffer is not None and buffer.size else np.zeros(0, kind)


def _all(rows: list[tuple], at: int, kind: str) -> np.ndarray:
    return np.concatenate([_array(r[at], kind) for r in rows]) if rows else np.zeros(0, kind)


def _blobs(x: np.ndarray) -> pa.Array:
    """The rows of a matrix as bytes."""
    x = np.ascontiguousarray(x)
    ends = np.arange(len(x) + 1, dtype=np.int64) * (x.strides[0] if len(x) else 0)
    return pa.Array.from_buffers(pa.large_binary(), len(x), [None, pa.py_buffer(ends), pa.py_buffer(x)]).cast(pa.binary())


def _matrix(column: pa.Array, kind: str) -> np.ndarray:
    n = len(column)
    ends = np.frombuffer(column.buffers()[1], np.int32)[column.offset:column.offset + n + 1]
    return np.frombuffer(column.buffers()[2], np.uint8)[ends[0]:ends[-1]].view(kind).reshape(n, -1)


def _packed(rows: Iterable[tuple]) -> Iterator[pa.RecordBatch]:
    """Rows of part, kind, sender and up to six arrays, as batches."""
    held, size = [], 0

    def batch() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*held), FIELDS)], schema=FIELDS)

    for part, kind, src, *arrays in rows:
        cells = [np.ascontiguousarray(x).tobytes() for x in arrays]
        held.append((int(part), kind, int(src), *cells, *[None] * (6 - len(cells))))
        size += sum(map(len, cells))
        if size > AT_ONCE:
            yield batch()
            held, size = [], 0
    if held:
        yield batch()


def _step(frames: list[DataFrame], parts: int, work: Callable, schema: str = PACK) -> DataFrame:
    """`work` of every part: it takes the part and what has come to it, by kind, and yields rows (batches, if the schema is another)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here: dict = defaultdict(lambda: defaultdict(list))
        for batch in batches:
            heads = [batch.column(i).to_numpy().tolist() for i in range(3)]
            for k, (part, kind, src) in enumerate(zip(*heads)):
                here[part][kind].append((src, *(batch.column(i)[k].as_buffer() for i in range(3, 9))))
        for part in sorted(here):
            made = work(part, here.pop(part))
            yield from _packed(made) if schema == PACK else made

    frame = frames[0]
    for x in frames[1:]:
        frame = frame.unionAll(x)
    return frame.repartitionById(parts, "part").mapInArrow(run, schema)


def _of(frame: DataFrame, *kinds: int) -> DataFrame:
    return frame.where(F.col("kind").isin(*kinds))


def _address(part: int, rows: np.ndarray) -> np.ndarray:
    return (np.int64(part) << np.int64(32)) | rows.astype(np.int64)


def _row(addresses: np.ndarray) -> np.ndarray:
    return (addresses & 0xFFFFFFFF).astype(np.int32)


def _runs(sorted_: np.ndarray) -> np.ndarray:
    """Where runs of equal values begin, and the end."""
    return np.concatenate([[0], np.flatnonzero(sorted_[1:] != sorted_[:-1]) + 1, [len(sorted_)]]) if len(sorted_) else np.zeros(1, np.int64)


def _homes(addresses: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """The parts of addresses, and where theirs are."""
    home = addresses >> 32
    order = np.argsort(home, kind="stable")
    ends = _runs(home[order])
    for lo, hi in zip(ends[:-1], ends[1:]):
        yield int(home[order[lo]]), order[lo:hi]


def _foremost(owner: np.ndarray, keys: tuple, most: int) -> np.ndarray:
    """Where the `most` first of every owner by `keys` (the last one first) are; in that order."""
    order = np.lexsort((*keys, owner))
    ends = _runs(owner[order])
    return order[np.arange(len(order)) - np.repeat(ends[:-1], np.diff(ends)) < most]


def _once(owner: np.ndarray, other: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Where each pair is, of several the one whose `first` is least."""
    order = np.lexsort((first, other, owner))
    a, b = owner[order], other[order]
    new = np.ones(len(order), bool)
    new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    return order[new]


def _dice(a: np.ndarray, b: np.ndarray, label: int) -> np.ndarray:
    x = a.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) ^ (b.astype(np.uint64) + np.uint64(label + 1)) * np.uint64(0xC2B2AE3D27D4EB4F)
    for shift, times in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(times)
    return x ^ (x >> np.uint64(31))


def _products(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Squared distances by products, and the sums of the squared lengths."""
    lengths = (a * a).sum(-1)[..., :, None] + (b * b).sum(-1)[..., None, :]
    return lengths - 2 * (a @ np.swapaxes(b, -1, -2)), lengths


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances row by row, of differences."""
    d = a - b
    return np.einsum("ij,ij->i", d, d)


def _exact(near: np.ndarray, lengths: np.ndarray, a: Callable, b: Callable) -> np.ndarray:
    """Distances of pairs, those anew whose products say little; `a` and `b` give the vectors of some."""
    again = np.flatnonzero(near <= CLOSE * lengths)
    for at in range(0, len(again), PART):
        some = again[at:at + PART]
        near[some] = _distances(a(some), b(some))
    return near


def _found(part: int, owner: np.ndarray, d: np.ndarray, other: np.ndarray, most: int) -> Iterator[tuple]:
    """What to hand to the homes of the owners: the `most` nearest others of each."""
    keep = _once(owner, other, d)
    owner, d, other = owner[keep], d[keep], other[keep]
    keep = _foremost(owner, (other, d), most)
    owner, d, other = owner[keep], d[keep], other[keep]
    for home, s in _homes(owner):
        yield home, FOUND, part, _row(owner[s]), other[s], d[s]


def _placed(codes: DataFrame, pivots: np.ndarray, degree: int, kind: str, parts: int) -> DataFrame:
    """Vectors, ids and who asks of every part, and empty lists; neighbours in the order of pivots share a part."""

    def cell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                x = _flat(batch.column(1)).astype(kind)
                near = _products(x.astype(np.float64), pivots)[0].argmin(1)
                yield pa.RecordBatch.from_arrays([batch.column(0), _blobs(x), batch.column(2), pa.array(near, pa.int32())], names=["id", "code", "asks", "cell"])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        own = [(b.column(0).to_numpy(), _matrix(b.column(1), kind), b.column(2).to_numpy(zero_copy_only=False)) for b in batches if len(b)]
        if own:
            ids, x, asks = (np.concatenate(c) for c in zip(*own))
            piece = TaskContext.get().partitionId()
            yield piece, VECTORS, piece, x, ids.astype(np.int64), asks.astype(bool)

    def gather(part: int, got: dict) -> Iterator[tuple]:
        pieces = sorted(got[VECTORS], key=lambda r: r[0])
        x, ids, asks = (_all(pieces, 1 + i, x) for i, x in enumerate((kind, "i8", "?")))
        shape = len(ids), degree
        yield part, VECTORS, part, x, ids, asks
        yield part, LISTS, part, np.full(shape, -1, np.int64), np.full(shape, np.inf), np.zeros(shape, bool), np.zeros(2, np.int64)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _packed(rows(batches))

    placed = codes.mapInArrow(cell, "id bigint, code binary, asks boolean, cell int").withColumn("dice", F.xxhash64("id"))
    pieces = placed.repartitionByRange(parts, "cell", "dice").sortWithinPartitions("cell", "dice", "id", "code").select("id", "code", "asks").mapInArrow(pack, PACK)
    pieces = settled(pieces, "vector-pieces")
    # Spark may have dealt them to more or fewer than asked for
    dealt = pieces.agg(F.max("part")).first()[0] + 1
    homes = settled(_step([pieces.withColumn("part", F.expr(f"int(part * {parts}L div {max(dealt, parts)})"))], parts, gather), "vector-homes")
    discard(pieces)
    return homes


def _start(vectors: DataFrame, lists: DataFrame, parts: int, pivots: np.ndarray, degree: int, kind: str, label: int) -> DataFrame:
    """The nearest within blocks of vectors that have the same nearest pivot."""

    def cells(part: int, got: dict) -> Iterator[pa.RecordBatch]:
        for (_, to, d, *_), (_, x, ids, *_) in zip(got[LISTS], got[VECTORS]):
            n = len(_array(ids, "i8"))
            x, worst = _array(x, kind).reshape(n, -1), _array(d, "f8").reshape(n, degree)[:, -1]
            for at in range(0, n, PART):
                near = _products(x[at:at + PART].astype(np.float64), pivots)[0].argmin(1)
                own = _address(part, np.arange(at, at + len(near)))
                yield pa.RecordBatch.from_arrays([pa.array(own), _blobs(x[at:at + PART]), pa.array(worst[at:at + PART]), pa.array(near, pa.int32())], names=["id", "code", "worst", "cell"])

    def leaves(x: np.ndarray, tree: int) -> Iterator[np.ndarray]:
        todo, dice = [np.arange(len(x))], np.random.RandomState(1009 * label + tree)
        while todo:
            rows = todo.pop()
            if len(rows) <= BLOCK:
                yield rows
            else:
                a, b = x[rows[dice.choice(len(rows), 2, replace=False)]].astype(np.float64)
                order = np.argpartition(x[rows] @ (a - b), len(rows) // 2)
                todo += [rows[order[:len(rows) // 2]], rows[order[len(rows) // 2:]]]

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        part = TaskContext.get().partitionId()
        for batch in batches:
            if not len(batch):
                continue
            ids, x, worst, kept = batch.column(0).to_numpy(), _matrix(batch.column(1), kind), batch.column(2).to_numpy(), []
            for tree in range(TREES if len(ids) > BLOCK else 1):
                for rows in leaves(x, tree):
                    i, v, w = ids[rows], x[rows].astype(np.float64), worst[rows]
                    near, lengths = _products(v, v)
                    np.fill_diagonal(near, np.inf)
                    hit = near - ROUNDING * lengths < w[:, None]
                    if hit.sum() > 2 * degree * len(i):
                        # what is not among the nearest for any rounding needs no exact distance
                        last = np.partition(near, min(degree, len(i)) - 1, axis=1)[:, min(degree, len(i)) - 1]
                        hit &= near - 2 * ROUNDING * lengths <= last[:, None]
                    a, b = np.nonzero(hit & np.isfinite(near))
                    d = _exact(near[a, b], lengths[a, b], lambda s: v[a[s]], lambda s: v[b[s]])  # noqa: B023
                    kept.append((i[a], d, i[b]))
            yield from _found(part, *(np.concatenate(c) for c in zip(*kept)), degree)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _packed(blocks(batches))

    placed = _step([vectors, lists], parts, cells, "id bigint, code binary, worst double, cell int").withColumn("dice", F.xxhash64("id", F.lit(label)))
    return placed.repartitionByRange(parts, "cell", "dice").sortWithinPartitions("cell", "dice").select("id", "code", "worst").mapInArrow(pack, PACK)


def _merged(lists: DataFrame, found: DataFrame, parts: int, degree: int, starts: bool) -> DataFrame:
    """Lists with the nearest of what they had and what was found; fresh is what was found, at the start all."""

    def merge(part: int, got: dict) -> Iterator[tuple]:
        (_, to, dist, *_), = got[LISTS]
        to, dist = _array(to, "i8").reshape(-1, degree), _array(dist, "f8").reshape(-1, degree)
        row, col = np.nonzero(to >= 0)
        owner = np.concatenate([row, _all(got[FOUND], 1, "i4")])
        other, d = np.concatenate([to[row, col], _all(got[FOUND], 2, "i8")]), np.concatenate([dist[row, col], _all(got[FOUND], 3, "f8")])
        fresh = np.arange(len(owner)) >= len(row)
        keep = _once(owner, other, np.where(fresh, d, -1.0))
        owner, other, d, fresh = owner[keep], other[keep], d[keep], fresh[keep]
        keep = _foremost(owner, (other, d), degree)
        owner, other, d, fresh = owner[keep], other[keep], d[keep], fresh[keep] | starts
        ends = _runs(owner)
        place = np.arange(len(owner)) - np.repeat(ends[:-1], np.diff(ends))
        new = np.full(to.shape, -1, np.int64), np.full(to.shape, np.inf), np.zeros(to.shape, bool)
        for x, y in zip(new, (other, d, fresh)):
            x[owner, place] = y
        yield part, LISTS, part, *new, np.array([fresh.sum(), len(owner)], np.int64)

    return _step([lists, found], parts, merge)


def _backwards(lists: DataFrame, parts: int, degree: int, most: int, label: int) -> DataFrame:
    """Edges to where they lead, at most `most` of every part for a vector."""

    def send(part: int, got: dict) -> Iterator[tuple]:
        (_, to, _, fresh, *_), = got[LISTS]
        to, fresh = _array(to, "i8").reshape(-1, degree), _array(fresh, "?").reshape(-1, degree)
        row, col = np.nonzero(to >= 0)
        fresh, to, own = fresh[row, col], to[row, col], _address(part, row)
        dice = _dice(own, to, label)
        keep = _foremost(to, (own, dice), most)
        fresh, to, own, dice = fresh[keep], to[keep], own[keep], dice[keep]
        for home, s in _homes(to):
            yield home, BACK, part, _row(to[s]), own[s], fresh[s], dice[s]

    return _step([lists], parts, send)


def _both(got: dict, degree: int, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Edges (row, address, fresh) of a part's lists and, at most `most` by hash, those that lead back."""
    (_, to, _, fresh, *_), = got[LISTS]
    to, fresh = _array(to, "i8").reshape(-1, degree), _array(fresh, "?").reshape(-1, degree)
    row, col = np.nonzero(to >= 0)
    end, own, new, dice = (_all(got[BACK], 1 + i, kind) for i, kind in enumerate(("i4", "i8", "?", "u8")))
    keep = _foremost(end, (own, dice), most)
    center, member, new = np.concatenate([row, end[keep]]), np.concatenate([to[row, col], own[keep]]), np.concatenate([fresh[row, col], new[keep]])
    keep = _once(center, member, ~new)
    return center[keep], member[keep], new[keep]


def _meet(vectors: DataFrame, lists: DataFrame, parts: int, degree: int, kind: str, number: int) -> tuple[DataFrame, DataFrame]:
    """What the neighbours of every vector find among each other, and the members as settled.

    Who meets is settled by addresses alone; only members of a center that has a fresh one get their vectors, once a part.
    """

    def members(part: int, got: dict) -> Iterator[tuple]:
        center, member, fresh = _both(got, degree, degree)
        alive = np.zeros(int(center.max(initial=-1)) + 1, bool)
        alive[center[fresh]] = True
        center, member, fresh = (x[alive[center]] for x in (center, member, fresh))
        if len(center):
            yield part, MEMBERS, part, center.astype(np.int32), member, fresh
        needed = np.unique(member)
        for home, s in _homes(needed):
            yield home, WANTED, part, _row(needed[s])

    def seat(part: int, got: dict) -> Iterator[tuple]:
        (_, x, ids, *_), = got[VECTORS]
        (_, _, dist, *_), = got[LISTS]
        x, worst = _array(x, kind).reshape(len(_array(ids, "i8")), -1), _array(dist, "f8").reshape(-1, degree)[:, -1]
        for src, rows, *_ in got[WANTED]:
            rows = _array(rows, "i4")
            yield src, SEATED, part, x[rows], _address(part, rows), worst[rows]

    def compare(part: int, got: dict) -> Iterator[tuple]:
        if not got[MEMBERS]:
            return
        (_, center, member, fresh, *_), = got[MEMBERS]
        center, member, fresh = _array(center, "i4"), _array(member, "i8"), _array(fresh, "?")
        seats = got.pop(SEATED)
        names, worst, x = _all(seats, 2, "i8"), _all(seats, 3, "f8"), _all(seats, 1, kind).reshape(sum(r[2].size for r in seats) // 8, -1)
        del seats
        order = np.argsort(names)
        seat_of = order[np.searchsorted(names, member, sorter=order)]
        ends = _runs(center)
        sizes, kept, size = np.diff(ends), [], 0
        for at in range(0, len(sizes), SLAB):
            n, lo = sizes[at:at + SLAB], ends[at]
            hi, wide = ends[min(at + SLAB, len(sizes))], int(n.max())
            line = np.repeat(np.arange(len(n)), n)
            column = np.arange(lo, hi) - np.repeat(ends[at:at + len(n)], n)
            seat, new, there = np.zeros((len(n), wide), np.int64), np.zeros((len(n), wide), bool), np.zeros((len(n), wide), bool)
            seat[line, column], new[line, column], there[line, column] = seat_of[lo:hi], fresh[lo:hi], True
            v, w = x[seat].astype(np.float64), np.where(there, worst[seat], -np.inf)
            near, lengths = _products(v, v)
            most = np.maximum(w[:, :, None], w[:, None, :])
            hit = (new[:, :, None] | new[:, None, :]) & there[:, :, None] & there[:, None, :] & (near - ROUNDING * lengths < most)
            c, a, b = np.nonzero(hit & np.triu(np.ones((wide, wide), bool), 1))
            d = _exact(near[c, a, b], lengths[c, a, b], lambda s: v[c[s], a[s]], lambda s: v[c[s], b[s]])  # noqa: B023
            for p, q in ((a, b), (b, a)):
                nearer = d < w[c, p]
                kept.append((names[seat[c, p]][nearer], d[nearer], names[seat[c, q]][nearer]))
                size += len(kept[-1][0])
            if size > HELD:
                yield from _found(part, *(np.concatenate(k) for k in zip(*kept)), degree)
                kept, size = [], 0
        if size:
            yield from _found(part, *(np.concatenate(k) for k in zip(*kept)), degree)

    met = settled(_step([lists, _backwards(lists, parts, degree, degree, number)], parts, members), "graph-members")
    seated = _step([vectors, lists, _of(met, WANTED)], parts, seat)
    return _step([_of(met, MEMBERS), seated], parts, compare), met


def neighbour_graph(vectors: DataFrame, lists: DataFrame, parts: int, pivots: np.ndarray, degree: int, kind: str, changed: float, iterations: int | None = None) -> DataFrame:
    """Rows of `LISTS`: addresses and distances of the nearest found of every vector, nearest first."""
    graph, number = lists, 0
    for label in range(0, len(pivots), PIVOTS):
        before, graph = graph, settled(_merged(graph, _start(vectors, graph, parts, pivots[label:label + PIVOTS], degree, kind, label), parts, degree, True), "graph")
        if before is not lists:
            discard(before)
    while True:
        # distances only fall, so at some time nothing is fresh
        fresh, every = np.sum([np.frombuffer(r["d"], np.int64) for r in graph.select("d").toLocalIterator()], axis=0)
        if number == iterations or not fresh or fresh <= changed * every:
            return graph
        found, met = _meet(vectors, graph, parts, degree, kind, number)
        next_ = settled(_merged(graph, found, parts, degree, False), "graph")
        discard(graph, met)
        release(graph.sparkSession)
        graph, number = next_, number + 1


def _links(graph: DataFrame, parts: int, degree: int) -> DataFrame:
    """The graph with its edges in both directions, of those back to a vector at most twice `degree` by hash."""

    def link(part: int, got: dict) -> Iterator[tuple]:
        n = len(_array(got[LISTS][0][1], "i8")) // degree
        row, to, _ = _both(got, degree, 2 * degree)
        yield part, LINKS, part, np.searchsorted(row, np.arange(n + 1)).astype(np.int64), to

    return _step([graph, _backwards(graph, parts, degree, 2 * degree, -1)], parts, link)


def _expand(part: int, q: np.ndarray, addresses: np.ndarray) -> Iterator[tuple]:
    for home, s in _homes(addresses):
        yield home, EXPAND, part, q[s].astype(np.int32), _row(addresses[s])


def graph_search(graph: DataFrame, vectors: DataFrame, parts: int, degree: int, kind: str, beam: int, most: int, rounds: int | None = None) -> DataFrame:
    """The `most` nearest nodes (q, id) that each query reaches; queries are the nodes that ask."""

    def begin(part: int, got: dict) -> Iterator[tuple]:
        (_, x, ids, asks, *_), = got[VECTORS]
        ids = _array(ids, "i8")
        rows = np.flatnonzero(_array(asks, "?"))
        if len(rows):
            own, shape = _address(part, rows), (len(rows), beam)
            yield part, ASKING, part, own, ids[rows], _array(x, kind).reshape(len(ids), -1)[rows], np.full(shape, -1, np.int64), np.full(shape, np.inf), np.zeros(shape, bool)
            yield from _expand(part, np.arange(len(rows)), own)

    def look_up(part: int, got: dict) -> Iterator[tuple]:
        if got[EXPAND]:
            (_, ends, to, *_), = got[LINKS]
            ends, to = _array(ends, "i8"), _array(to, "i8")
            for src, q, rows, *_ in got[EXPAND]:
                q, rows = _array(q, "i4"), _array(rows, "i4")
                n = ends[rows + 1] - ends[rows]
                at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(ends[rows], n)
                pairs = np.repeat(q, n), to[at]
                keep = _once(*pairs, np.zeros(len(at), bool))
                yield src, LINKED, part, pairs[0][keep], pairs[1][keep]

    def asked(got: dict) -> tuple:
        (_, own, ids, x, near, d, done), = got[ASKING]
        own = _array(own, "i8")
        return own, _array(ids, "i8"), _array(x, kind).reshape(len(own), -1), _array(near, "i8").reshape(-1, beam), _array(d, "f8").reshape(-1, beam), _array(done, "?").reshape(-1, beam)

    def choose(part: int, got: dict) -> Iterator[tuple]:
        if not got[LINKED]:
            return
        own, _, x, near, d, _ = asked(got)
        q, to = _all(got[LINKED], 1, "i4"), _all(got[LINKED], 2, "i8")
        # what is among the nearest already, or the query itself, comes first of its pairs and goes
        known, col = np.nonzero(near >= 0)
        who, what = np.concatenate([known, np.arange(len(own)), q]), np.concatenate([near[known, col], own, to])
        late = np.arange(len(who)) >= len(known) + len(own)
        keep = _once(who, what, late)
        keep = keep[late[keep]]
        q, to = who[keep], what[keep]
        for home, s in _homes(to):
            some, at = np.unique(q[s], return_inverse=True)
            yield home, MEASURE, part, at.astype(np.int32), _row(to[s]), x[some], d[some, -1], some.astype(np.int32)

    def measure(part: int, got: dict) -> Iterator[tuple]:
        if got[MEASURE]:
            (_, x, ids, *_), = got[VECTORS]
            x = _array(x, kind).reshape(len(_array(ids, "i8")), -1)
            for src, at, rows, v, bound, some, _ in got[MEASURE]:
                at, rows, bound, some = _array(at, "i4"), _array(rows, "i4"), _array(bound, "f8"), _array(some, "i4")
                v = _array(v, kind).reshape(len(some), -1).astype(np.float64)
                d = np.concatenate([_distances(x[rows[k:k + PART]], v[at[k:k + PART]]) for k in range(0, len(at), PART)])
                near = d <= bound[at]
                if near.any():
                    yield src, MEASURED, part, some[at[near]], _address(part, rows[near]), d[near]

    def take(part: int, got: dict) -> Iterator[tuple]:
        if not got[ASKING]:
            return
        own, ids, x, near, d, done = asked(got)
        row, col = np.nonzero(near >= 0)
        q = np.concatenate([row, _all(got[MEASURED], 1, "i4")])
        to, dist = np.concatenate([near[row, col], _all(got[MEASURED], 2, "i8")]), np.concatenate([d[row, col], _all(got[MEASURED], 3, "f8")])
        done = np.concatenate([done[row, col], np.zeros(len(q) - len(row), bool)])
        keep = _foremost(q, (to, dist), beam)
        q, to, dist, done = q[keep], to[keep], dist[keep], done[keep]
        ends = _runs(q)
        place = np.arange(len(q)) - np.repeat(ends[:-1], np.diff(ends))
        new = np.full(near.shape, -1, np.int64), np.full(near.shape, np.inf), np.zeros(near.shape, bool)
        new[0][q, place], new[1][q, place], new[2][q, place] = to, dist, True
        yield part, ASKING, part, own, ids, x, *new
        yield from _expand(part, q[~done], to[~done])

    def nearest_of(part: int, got: dict) -> Iterator[tuple]:
        if got[ASKING]:
            _, ids, _, near, d, _ = asked(got)
            # with all that are as far as the last of them
            q, col = np.nonzero((near >= 0) & (d <= d[:, min(most, beam) - 1, None]))
            to, dist = near[q, col], d[q, col]
            for home, s in _homes(to):
                yield home, NAMED, part, ids[q[s]], _row(to[s]), dist[s]

    def name(part: int, got: dict) -> Iterator[pa.RecordBatch]:
        if got[NAMED]:
            ids, rows = _array(got[VECTORS][0][2], "i8"), _all(got[NAMED], 2, "i4")
            yield pa.RecordBatch.from_arrays([pa.array(_all(got[NAMED], 1, "i8")), pa.array(ids[rows]), pa.array(_all(got[NAMED], 3, "f8"))], names=["q", "id", "d"])

    links = settled(_links(graph, parts, degree), "graph-links")
    state, number = settled(_step([vectors], parts, begin), "graph-reached"), -1
    while number != rounds and not _of(state, EXPAND).isEmpty():
        linked = _step([links, _of(state, EXPAND)], parts, look_up)
        measured = _step([vectors, _step([_of(state, ASKING), linked], parts, choose)], parts, measure)
        next_ = settled(_step([_of(state, ASKING), measured], parts, take), "graph-reached")
        discard(state)
        release(state.sparkSession)
        state, number = next_, number + 1
    found = _step([vectors, _step([_of(state, ASKING)], parts, nearest_of)], parts, name, "q bigint, id bigint, d double")
    place = F.row_number().over(Window.partitionBy("q").orderBy("d", "id"))
    return settled(found.withColumn("place", place).where(F.col("place") <= most).select("q", "id"), "graph-found")


def nearest(rows: DataFrame, is_query: Column, key: str = "vec_id", vector: str = "embedding", k: int = 10, degree: int = 20, changed: float = 0.05,
            beam: int = 384, iterations: int | None = None, rounds: int | None = None) -> DataFrame:
    """For every row that `is_query` says, its `k` nearest other rows: `query_id`, `rank` (from 1), key and `score` (the distance).

    `iterations` and `rounds` are limits for trials; without them graph and search go on until they have settled.
    """
    kept = rows.select(F.col(key).cast("bigint").alias("id"), F.transform(F.col(vector), lambda x: x.cast("double")).alias("vector"), F.coalesce(is_query, F.lit(False)).alias("asks"))
    kept = kept.where(F.col("id").isNotNull() & usable(F.col("vector")))
    kept = settled(kept.groupBy("id", "vector").agg(F.bool_or("asks").alias("asks")), "vectors")
    common = kept.groupBy(F.size("vector").alias("length")).agg(F.count(F.lit(1)).alias("n"))
    most = common.orderBy(F.desc("n"), F.desc("length")).first()  # one row
    if most is None:
        return rows.sparkSession.createDataFrame([], f"query_id bigint, rank int, {key} bigint, score double")
    kept = kept.where(F.size("vector") == most["length"])

    nodes = settled(kept.groupBy("vector").agg(F.min("id").alias("id"), F.bool_or("asks").alias("asks")), "vector-nodes")
    kind = "float" if rows.schema[vector].dataType.elementType.typeName() == "float" else "double"  # nothing is lost
    codes = settled(nodes.select("id", F.col("vector").cast(f"array<{kind}>").alias("code"), "asks"), "vector-codes")
    # a bounded sample, whatever the rows
    count = codes.count()
    some = PIVOTS * (STARTS if count > BLOCK else 1)  # one block holds all
    pivots = np.array([r["code"] for r in codes.orderBy(F.xxhash64("id"), "id").limit(some).toLocalIterator()])
    kind = "f4" if kind == "float" else "f8"
    of_a_part = max(256, SEATS // (2 * degree * pivots[0].size * np.dtype(kind).itemsize))
    parts = max(-(-count // of_a_part), min(FEW, -(-count // BLOCK)))
    homes = _placed(codes, pivots[:PIVOTS], degree, kind, parts)
    vectors, lists = _of(homes, VECTORS), _of(homes, LISTS)
    graph = neighbour_graph(vectors, lists, parts, pivots, degree, kind, changed, iterations)
    found = graph_search(graph, vectors, parts, degree, kind, beam, 5 * k, rounds)

    # a node answers with its own copies too; each node names its k + 1 smallest ids
    own = nodes.where("asks").select(F.col("id").alias("q"), "id")
    place = F.row_number().over(Window.partitionBy("vector").orderBy("id"))
    copies = kept.select("id", "vector").withColumn("place", place).where(F.col("place") <= k + 1).join(nodes.select("vector", F.col("id").alias("node")), "vector").select("node", F.col("id").alias("named"))
    vectors = nodes.select("id", "vector")
    score = F.sqrt(F.aggregate(F.zip_with("vector_q", "vector", lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))
    scored = found.unionAll(own).join(vectors, "id").join(vectors.select(F.col("id").alias("q"), F.col("vector").alias("vector_q")), "q").select("q", F.col("id").alias("node"), score.alias("score"))
    asked = kept.where("asks").join(nodes.select("vector", F.col("id").alias("q")), "vector").select(F.col("id").alias("query_id"), "q")
    answers = scored.join(copies, "node").join(asked, "q").where("query_id <> named")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "named"))
    out = answers.select("query_id", "named", "score").distinct().withColumn("rank", rank.cast("int")).where(F.col("rank") <= k)
    return out.select("query_id", "rank", F.col("named").alias(key), "score")
