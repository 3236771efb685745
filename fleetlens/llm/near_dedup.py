"""Near duplicates by banded min-max signatures, confirmed on full shingle sets.

1. Every text becomes its set of five-word shingles (64-bit hashes), a digest of the set and the band keys of its
   min-max signature. Texts with equal sets are one class from here on, its smallest id for all of them.
2. Classes that share a band key are candidates. A bucket never gives all its pairs: every member meets the bucket's
   smallest member alone. Of a class's partners, the one it shares most buckets with is confirmed first; the others
   only where the two are not connected by then.
3. Buckets that still hold two components may hide links between members that never met. Their classes go through an
   exact prefix join: two sets with the similarity in question share a shingle among the first few of each in one
   common order, with enough of each left behind it. Shingles of one component alone come first in that order and
   then the rare ones, so most classes have nothing left to join; and pairs within a component are not formed.
4. Confirmed links give the components.

With 48 bands of 5 values, two sets of similarity 0.75 miss all buckets with a probability of 2.3 in a million, of
0.8 with 6 in a hundred million. Nothing is capped: large groups of copies are one class, large groups of near copies cost a
few pairs a member.

Defined results: a null or empty text, or one without words, has an empty set and is linked with nothing; texts of one
to four words are one shingle. Rows that share an id are one document, and the links of each of its texts count. A
row without an id has no component and is kept. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetlens.llm.components import components
from fleetlens.llm.shingles import MinMax, mixed, shingle_set
from fleetlens.llm.storage import settled

BANDS, ROWS = 48, 5
SKETCH = "id bigint, n_shingles bigint, low bigint, high bigint, keys array<bigint>"
SETS = "id bigint, n bigint, shingles array<bigint>"

#: Shingles that are hashed together.
PART = 200_000


def _in_parts(ids: pa.Array, texts: pa.Array) -> Iterator[tuple[list, list[np.ndarray]]]:
    """The ids and shingle sets of a batch, in parts of bounded size."""
    some, sets, size = [], [], 0
    for i, t in zip(ids.to_pylist(), texts):
        s = shingle_set(t.as_py())
        some.append(i)
        sets.append(s)
        size += len(s)
        if size > PART:
            yield some, sets
            some, sets, size = [], [], 0
    if some:
        yield some, sets


def lists(values: np.ndarray, sizes: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), pa.array(values.view(np.int64)))


def sketches(docs: DataFrame, bands: int, rows: int) -> DataFrame:
    """Of every row of (id, text): the size and digest of its set, and its band keys."""

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        minmax = MinMax(bands, rows)
        for batch in batches:
            for ids, sets in _in_parts(batch.column(0), batch.column(1)):
                sizes = np.array([len(s) for s in sets], np.int64)
                flat = np.concatenate(sets)
                full = sizes > 0
                starts = (np.cumsum(sizes) - sizes)[full]
                low, high = np.zeros(len(ids), np.uint64), np.zeros(len(ids), np.uint64)
                keys = np.zeros((0, bands), np.uint64)
                if len(flat):
                    low[full] = np.add.reduceat(mixed(flat), starts)
                    high[full] = np.bitwise_xor.reduceat(mixed(flat ^ np.uint64(0x5851F42D4C957F2D)), starts)
                    keys = minmax.keys(flat, starts)
                yield pa.RecordBatch.from_arrays([
                    pa.array(ids, pa.int64()), pa.array(sizes), pa.array(low.view(np.int64)), pa.array(high.view(np.int64)),
                    lists(keys.ravel(), np.where(full, bands, 0))], names=["id", "n_shingles", "low", "high", "keys"])

    return docs.mapInArrow(sketch, SKETCH)


def sets_of(docs: DataFrame) -> DataFrame:
    """The shingle set of every row of (id, text)."""

    def full(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, sets in _in_parts(batch.column(0), batch.column(1)):
                sizes = np.array([len(s) for s in sets], np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(sizes), lists(np.concatenate(sets), sizes)], names=["id", "n", "shingles"])

    return docs.mapInArrow(full, SETS)


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int, sized: bool = False) -> DataFrame:
    """The pairs (a, b) of which the shared shingles are at least `percent` of all; `sized` says that their sizes allow it, as those of `prefix_pairs` do."""
    likely = pairs
    if not sized:
        for x in ("a", "b"):
            likely = likely.join(sets.select(F.col("id").alias(x), F.col("n").alias(f"n_{x}")), x)
        # what the sizes rule out never meets its sets
        likely = likely.where(F.least("n_a", "n_b") * 100 >= F.greatest("n_a", "n_b") * percent).select("a", "b")
    for x in ("a", "b"):
        likely = likely.join(sets.select(F.col("id").alias(x), F.col("n").alias(f"n_{x}"), F.col("shingles").alias(f"set_{x}")), x)
    both = F.size(F.array_intersect("set_a", "set_b"))
    return likely.select("a", "b", "n_a", "n_b", both.alias("both")).where(F.col("both") * 100 >= (F.col("n_a") + F.col("n_b") - F.col("both")) * percent).select("a", "b")


def prefix_pairs(members: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of different components that may reach `percent`, of rows (id, n, shingles, component); with both components (x, y) and the `shared` prefix shingles.

    A set of n shingles that reaches it with another shares at least ceil(n * percent / 100) of them, so it has one
    of the shared ones among its first n - that + 1, in whatever order both follow.
    """
    tokens = members.select("id", "n", "component", F.explode("shingles").alias("s"))
    # a shingle of one component alone takes a place in the prefix and joins nothing
    shared = tokens.groupBy("s").agg(F.count(F.lit(1)).alias("docs"), F.min("component").alias("x"), F.max("component").alias("y")).where("x <> y").select("s", "docs")
    ranked = (tokens.join(shared, "s").groupBy("id", "n", "component").agg(F.array_sort(F.collect_list(F.struct("docs", "s"))).alias("common")))
    places = F.size("common") - F.ceil(F.col("n") * percent / 100) + 1
    first = F.transform(F.slice("common", F.lit(1), places.cast("int")), lambda x, i: F.struct(x["s"].alias("s"), (F.col("n") - F.size("common") + i + 1).alias("rank")))
    prefix = ranked.where(places > 0).select("id", "n", "component", F.explode(first).alias("x")).select("id", "n", "component", "x.*")
    prefix = settled(prefix, "near-prefixes")
    # the largest component of a shingle stands on one side alone
    per = prefix.groupBy("s", "component").agg(F.count(F.lit(1)).alias("docs"))
    main = per.groupBy("s").agg(F.max_by("component", F.struct("docs", "component")).alias("main"), F.count(F.lit(1)).alias("parts")).where("parts > 1").select("s", "main")
    left = prefix.join(main.select("s"), "s").select("s", *[F.col(x).alias(f"{x}_p") for x in ("id", "n", "component", "rank")])
    right = prefix.join(main, "s").where("component <> main").select("s", *[F.col(x).alias(f"{x}_q") for x in ("id", "n", "component", "rank")])
    # both sizes tell how many shingles must be shared; from the first shared one on, each set has to have as many left
    needed = F.ceil((F.col("n_p") + F.col("n_q")) * percent / (100 + percent))
    enough = 1 + F.least(F.col("n_p") - F.col("rank_p"), F.col("n_q") - F.col("rank_q")) >= needed
    met = left.alias("l").join(right.alias("r"), (F.col("l.s") == F.col("r.s")) & (F.col("component_p") != F.col("component_q")) & enough)
    ends = [F.least("id_p", "id_q").alias("a"), F.greatest("id_p", "id_q").alias("b"), F.least("component_p", "component_q").alias("x"), F.greatest("component_p", "component_q").alias("y")]
    return met.groupBy(*ends).agg(F.count(F.lit(1)).alias("shared"))


def in_open_buckets(met: DataFrame, place: DataFrame) -> DataFrame:
    """The members (id, component) of buckets that hold two components, of rows (id, bucket)."""
    at = met.join(place, met["id"] == place["node"], "left").select("id", "bucket", F.coalesce("component", "id").alias("component"))
    open_ = at.groupBy("bucket").agg(F.min("component").alias("x"), F.max("component").alias("y")).where("x <> y").select("bucket")
    return at.join(open_, "bucket", "left_semi").select("id", "component").distinct()


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", percent: int = 75, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """Of every row: the key, `n_shingles`, `component_id` (the smallest key that links reach) and `kept` (it is that key)."""
    texts = docs.select(F.col(key).cast("bigint").alias("id"), F.col(text).alias("text"))
    sketch = settled(sketches(texts, bands, rows), "near-sketches")
    worded = sketch.where("n_shingles > 0 AND id IS NOT NULL")
    same = ["n_shingles", "low", "high"]
    classes = settled(worded.groupBy(*same).agg(F.min("id").alias("class")), "near-classes")
    heads = settled(worded.select("id", "keys").join(classes.select(F.col("class").alias("id")), "id", "left_semi"), "near-heads")

    bands_of = heads.select("id", F.explode("keys").alias("bucket"))
    shared = bands_of.groupBy("bucket").agg(F.min("id").alias("first"), F.max("id").alias("last")).where("first < last").select("bucket", "first")
    met = settled(bands_of.join(shared, "bucket"), "near-buckets")
    pairs = met.where("id <> first").groupBy(F.col("first").alias("a"), F.col("id").alias("b")).agg(F.count(F.lit(1)).alias("buckets"))
    pairs = settled(pairs, "near-pairs")
    involved = met.select("id").distinct()
    sets = settled(sets_of(texts.join(involved, "id", "left_semi").select("id", "text")), "near-sets")

    best = pairs.groupBy("b").agg(F.max_by("a", F.struct("buckets", -F.col("a"))).alias("a"))
    links = settled(confirmed(best.select("a", "b"), sets, percent), "near-links")
    place = components(links)
    rest = _across(pairs, place)
    links = settled(links.unionAll(confirmed(rest, sets, percent)), "near-links")

    place = components(links)
    rest = prefix_pairs(sets.join(in_open_buckets(met, place), "id"), percent)
    links = settled(links.unionAll(confirmed(rest, sets, percent)), "near-links")

    # an id with several texts connects their classes
    of = worded.select("id", *same).join(classes, same).select("id", "class")
    several = of.groupBy("id").agg(F.min("class").alias("x"), F.max("class").alias("y")).where("x <> y").select("id")
    links = links.unionAll(of.join(several, "id").select(F.col("class").alias("a"), F.col("id").alias("b")).distinct())

    place = components(links)
    found = sketch.select("id", *same).join(classes, same, "left")
    found = found.join(place, found["class"] == place["node"], "left")
    component = F.coalesce("component", "class", "id")
    return found.select(F.col("id").alias(key), "n_shingles", component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"))


def _across(pairs: DataFrame, place: DataFrame) -> DataFrame:
    """The pairs whose ends are in different components."""
    out = pairs.select("a", "b")
    for x in ("a", "b"):
        out = (out.join(place.select(F.col("node").alias(x), F.col("component").alias(f"of_{x}")), x, "left")
               .withColumn(f"of_{x}", F.coalesce(f"of_{x}", x)))
    return out.where("of_a <> of_b").select("a", "b")
