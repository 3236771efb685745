"""Repeated passages by banded MinHash of paragraphs.

Paragraphs are what a text shows as such: its lines, and where blank lines part them, the blocks of lines between, of at
least 27 words. Each distinct one has a banded MinHash signature over its five-word shingles; those that share a band key
are candidates. In a bucket each meets the first one alone; where a bucket still holds two components afterwards, an
exact prefix join finds the rest, so a bucket of any size never gives all its pairs. Of the pairs between the same two
components the one that shares most is confirmed first, the others only where the two are not connected by then. Pairs are confirmed by the exact
Jaccard similarity of their shingle sets, for which the texts in question are read again. Components of the confirmed
links are the clusters; the first paragraph of each, by document and position, is kept, and the others are removals.

A passage that repeats across documents seldom begins where a line begins. So runs of 27 words are paragraphs too, which
start where the text itself says: at the word whose five-word window has the smallest hash among 25 windows in a row.
Equal passages give equal runs wherever they stand, whatever their line breaks, and one of at least 51 words contains a
whole run for certain (among its first 25 windows is such a smallest one, and 27 words follow it). Runs are compared by
equality alone, by a 64-bit digest of the words: a changed word in the middle takes five of a run's 23 shingles, so near
copies of runs are below the similarity anyway, and what lies between changes is found by the runs that are whole.

Paragraphs are cut and hashed in one pass and written; equal ones are one class from there on, so only distinct written
paragraphs have bands, and copies, however many, cost one aggregate.

A passage begins before its first run and ends behind its last one, by at most 24 words (else there were one more run).
So runs at the edge of what repeats are extended word by word, as far as an earlier document with a paragraph of the
same cluster has the same words there (for a kept paragraph, a later one): prefixes of the words on that side are hashed
and meet by equality, so no text is compared with another. Copies, whose words on that side are all the same, are settled
as a whole; prefixes are taken apart only where a run finds no such copy, and beside it other words that begin alike. What overlaps in a document is one passage then, removals
and kept ones for themselves.

Tuning: 16 bands of four values. Equal paragraphs always meet; those of similarity 0.75 share a bucket with a probability
of 0.997, of 0.9 with more than 0.9999. What shares a bucket by chance is thrown out by the exact similarity.

Defined results: null, empty and shorter texts have no paragraph. Only paragraphs that another document shares are
returned, so a document of its own is absent; rows with one id are one document, and repeats inside a document are not
across documents. A row without an id takes no part. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fleetlens.llm.components import components
from fleetlens.llm.near_dedup import SETS, confirmed, in_open_buckets, lists, prefix_pairs
from fleetlens.llm.shingles import WIDTH, MinMax, mixed, windows, word_hashes
from fleetlens.llm.storage import discard, release, settled

WORDS = 27
WINDOW = 25
#: So many words of a passage lie outside its runs at most, on either side.
REACH = WINDOW - 1
#: For paragraphs as written.
BANDS, ROWS = 16, 4
PARAGRAPHS = "id bigint, start int, words int, line boolean, digest bigint, keys array<bigint>"
#: Keeps written paragraphs apart from runs.
LINE = np.uint64(0x94D049BB133111EB)
BESIDE = "id bigint, start int, component bigint, after boolean, asked boolean, own boolean, n int, lead bigint, whole bigint, keys array<bigint>"
#: Words that are hashed together.
PART = 32_000


def _over_rows(x: np.ndarray, pick: np.ufunc) -> np.ndarray:
    """`pick` over every WINDOW neighbours, from rows of doubled length."""
    n = 1
    while n < WINDOW:
        step = min(n, WINDOW - n)
        x = pick(x[:-step], x[step:])
        n += step
    return x


def _smallest_in_rows(w: np.ndarray) -> np.ndarray:
    """The places that are the first smallest of a row of WINDOW neighbours, in order."""
    least = _over_rows(w, np.minimum)
    beyond = np.zeros(WINDOW - 1, w.dtype)
    # a place is a smallest one if the largest minimum among the rows over it is its own
    found = np.flatnonzero(w == _over_rows(np.concatenate([beyond, least, beyond]), np.maximum))
    if ((np.diff(found) < WINDOW) & (w[found[1:]] == w[found[:-1]])).any():
        # equal ones in one row: the first counts there
        rows = np.lib.stride_tricks.sliding_window_view(w, WINDOW)
        found = np.unique(np.argmin(rows, axis=1) + np.arange(len(rows)))
    return found


def starts_of(h: np.ndarray) -> np.ndarray:
    """The first words of the paragraphs of a text, by the hashes of its words."""
    if len(h) < WORDS:
        return np.zeros(0, np.int64)
    w = windows(h)
    last = len(h) - WORDS  # the last start with all words
    if len(w) < WINDOW:
        # shorter than a row of windows: the smallest that has all its words
        return np.array([int(np.argmin(w[:last + 1]))])
    smallest = _smallest_in_rows(w)
    found = smallest[smallest <= last]
    return found if len(found) else np.array([last])


def written_of(text: str) -> tuple[np.ndarray, np.ndarray]:
    """The first words and the lengths of the paragraphs of a text as written: lines, and blocks of several lines
    where blank lines part the text."""
    counts = np.array([len(x.split()) for x in text.encode().split(b"\n")], np.int64)
    starts = np.cumsum(counts) - counts
    full = np.flatnonzero(counts)
    # a block ends where a line without words follows; blank lines at the ends of a text part nothing
    breaks = np.flatnonzero(np.diff(full) > 1) + 1
    if len(breaks):
        first = np.concatenate([[0], breaks])
        last = np.concatenate([breaks, [len(full)]]) - 1
        several = last > first
        block_starts = starts[full[first[several]]]
        block_counts = starts[full[last[several]]] + counts[full[last[several]]] - block_starts
        starts, counts = np.concatenate([starts, block_starts]), np.concatenate([counts, block_counts])
    return starts[counts >= WORDS], counts[counts >= WORDS]


def _spans(h: np.ndarray, starts: np.ndarray, words: np.ndarray) -> np.ndarray:
    """The shingles of each paragraph, one paragraph after the other."""
    counts = words - WIDTH + 1
    return windows(h)[np.repeat(starts - (np.cumsum(counts) - counts), counts) + np.arange(counts.sum())]


def paragraphs(docs: DataFrame) -> DataFrame:
    """The paragraphs of every row of (id, text): place, length, digest, and for those as written (`line`) the band keys."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch = MinMax(BANDS, ROWS)

        def out(line, ids, starts, words, shingles):
            words, flat = np.concatenate(words), np.concatenate(shingles)
            counts = words - WIDTH + 1
            begin = np.cumsum(counts) - counts
            digest = np.add.reduceat(mixed(flat + _place(counts)), begin)
            if line:
                digest, keys = digest ^ LINE, lists(sketch.keys(flat, begin).ravel(), np.full(len(ids), BANDS))
            else:
                keys = pa.nulls(len(ids), pa.list_(pa.int64()))
            return pa.RecordBatch.from_arrays([
                pa.array(ids, pa.int64()), pa.array(np.concatenate(starts), pa.int32()), pa.array(words, pa.int32()), pa.array([bool(line)] * len(ids)),
                pa.array(digest.view(np.int64)), keys], names=["id", "start", "words", "line", "digest", "keys"])

        for batch in batches:
            held = [([], [], [], []), ([], [], [], [])]
            size = [0, 0]
            for i, t in zip(batch.column(0).to_pylist(), batch.column(1)):
                text = t.as_py()
                h = word_hashes(text)
                if i is None or len(h) < WORDS:
                    continue
                first = starts_of(h)
                for line, (starts, words) in enumerate(((first, np.full(len(first), WORDS)), written_of(text))):
                    if not len(starts):
                        continue
                    ids, *rest = held[line]
                    ids.extend([i] * len(starts))
                    for x, y in zip(rest, (starts, words, _spans(h, starts, words))):
                        x.append(y)
                    size[line] += int(words.sum())
                    if size[line] > PART:
                        yield out(line, *held[line])
                        held[line], size[line] = ([], [], [], []), 0
            for line in (0, 1):
                if held[line][0]:
                    yield out(line, *held[line])

    return docs.mapInArrow(cut, PARAGRAPHS)


def _place(counts: np.ndarray) -> np.ndarray:
    """For shingles that lie one after the other by paragraph, a number for their place in it."""
    at = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
    return at.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)


def sets_at(docs: DataFrame) -> DataFrame:
    """The distinct shingles of paragraphs, of rows (id, text, places) with places as structs of start, words and digest; named by the digest."""

    def full(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, sets = [], []
            for t, places in zip(batch.column(1), batch.column(2)):
                h = word_hashes(t.as_py())
                for place in places.as_py():
                    # rows that share an id may differ in length
                    if place["start"] + place["words"] <= len(h):
                        names.append(place["digest"])
                        sets.append(np.unique(_spans(h, np.array([place["start"]]), np.array([place["words"]]))))
            if names:
                sizes = np.array([len(x) for x in sets])
                yield pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array(sizes, pa.int64()), lists(np.concatenate(sets), sizes)], names=["id", "n", "shingles"])

    return docs.mapInArrow(full, SETS)


def _beside(docs: DataFrame) -> DataFrame:
    """The hashes of the nearest 1, 2, ... words before or after runs, of rows (id, text, places) with places as structs of start, component, after, asked and own."""

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        far = np.arange(REACH)
        weights = mixed(np.arange(1, REACH + 1, dtype=np.uint64)) | np.uint64(1)

        def out(parts):
            *columns, counts, lead, whole, keys = [np.concatenate(x) for x in zip(*parts)]
            ends = [pa.array(counts, pa.int32()), pa.array(lead.view(np.int64)), pa.array(whole.view(np.int64)), lists(keys, counts)]
            return pa.RecordBatch.from_arrays([pa.array(x) for x in columns] + ends, names=["id", "start", "component", "after", "asked", "own", "n", "lead", "whole", "keys"])

        for batch in batches:
            offsets, places = batch.column(2).offsets.to_numpy(), batch.column(2).values
            fields = [places.field(x).to_numpy(zero_copy_only=False) for x in ("start", "component", "after", "asked", "own")]
            parts, size = [], 0
            for i, t, lo, hi in zip(batch.column(0).to_pylist(), batch.column(1), offsets[:-1], offsets[1:]):
                h = word_hashes(t.as_py())
                start, component, after, asked, own = [x[lo:hi] for x in fields]
                counts = np.minimum(REACH, np.where(after, len(h) - start - WORDS, start))
                # rows that share an id may differ in length
                there = (start + WORDS <= len(h)) & (counts > 0)
                if not there.any():
                    continue
                start, component, after, asked, own, counts = [x[there] for x in (start, component, after, asked, own, counts)]
                at = np.where(after[:, None], start[:, None] + WORDS + far, start[:, None] - 1 - far)
                keys = mixed(np.cumsum(mixed(h)[np.clip(at, 0, len(h) - 1)] * weights, axis=1, dtype=np.uint64))
                whole = keys[np.arange(len(counts)), counts - 1]
                parts.append((np.full(len(start), i, np.int64), start, component, after, asked, own, counts, keys[:, 0], whole, keys[far < counts[:, None]]))
                size += int(counts.sum())
                if size > PART:
                    yield out(parts)
                    parts, size = [], 0
            if parts:
                yield out(parts)

    return docs.mapInArrow(hashed, BESIDE)


def _islands(rows: DataFrame, group: list[str], lo: str, hi: str) -> DataFrame:
    """With `from` and `to` of what overlaps or touches within a group; a group is what one document has."""
    before = F.max(hi).over(Window.partitionBy(*group).orderBy(lo, hi).rowsBetween(Window.unboundedPreceding, -1))
    begins = rows.withColumn("begins", F.when(before >= F.col(lo), 0).otherwise(1))
    numbered = begins.withColumn("island", F.sum("begins").over(Window.partitionBy(*group).orderBy(lo, hi).rowsBetween(Window.unboundedPreceding, 0)))
    whole = Window.partitionBy(*group, "island")
    return numbered.withColumn("from", F.min(lo).over(whole)).withColumn("to", F.max(hi).over(whole)).drop("begins", "island")


def passages(rows: DataFrame, texts: DataFrame) -> DataFrame:
    """Paragraphs (id, start, words, line, component, own) with the passage `from` and `to` that each is part of; `own` says that its place is kept."""
    ends = rows.withColumn("end", F.col("start") + F.col("words"))
    runs = _islands(ends.where("NOT line"), ["id", "own"], "start", "end")
    # where other runs lie over all the words in reach, there is nothing to extend
    before = F.when(F.col("start") - REACH < F.col("from"), False)
    after = F.when(F.col("end") + REACH > F.col("to"), True)
    edges = settled(runs.select("id", "start", "component", "own", F.explode(F.array_compact(F.array(before, after))).alias("after")), "passage-edges")
    members = ends.where("NOT line").select("id", "start", "component", "own").join(edges.select("component", "after").distinct(), "component")
    members = members.join(edges.select("id", "start", "component", "after", F.lit(True).alias("asked")), ["id", "start", "component", "after"], "left")
    place = F.struct("start", "component", "after", F.coalesce("asked", F.lit(False)).alias("asked"), "own")
    places = members.groupBy("id").agg(F.collect_set(place).alias("places"))
    beside = settled(_beside(texts.join(places, "id").select("id", "text", "places")), "passage-beside")
    release(rows.sparkSession)

    # copies go on as one; a run that has one in an earlier (kept: later) document reaches as far as there are words
    group = ["component", "after", "lead"]
    same = [*group, "whole", "n"]
    sharers = [F.min("id").alias("first"), F.max("id").alias("last")]
    alike = settled(beside.groupBy(*same).agg(*sharers), "passage-alike")
    asked = settled(beside.where("asked").select("id", "start", "own", *same).join(alike, same), "passage-asked")
    there = "first < id OR own AND last > id"
    full = asked.where(there).select("id", "start", "component", "after", F.col("n").alias("more"))
    # the others share a part with other words that begin alike, if there are any in such a document
    others = alike.groupBy(*group).agg(F.count(F.lit(1)).alias("kinds"), F.min("first").alias("first"), F.max("last").alias("last")).where("kinds > 1")
    rest = settled(asked.where(f"NOT ({there})").drop("first", "last").join(others, group).where(there).select("id", "start", "own", *same), "passage-rest")
    kinds = beside.join(rest.select(*group).distinct(), group, "left_semi").groupBy(*same).agg(*sharers, F.first("keys").alias("keys"))
    kinds = settled(kinds, "passage-kinds")
    release(rows.sparkSession)
    discard(edges, beside, alike)
    each = kinds.select("component", "after", "first", "last", F.posexplode("keys").alias("place", "beside"))
    shared = each.groupBy("component", "after", "place", "beside").agg(F.min("first").alias("first"), F.max("last").alias("last")).where("first < last")
    apart = rest.join(kinds.select(*same, "keys"), same).select("id", "start", "component", "after", "own", F.posexplode("keys").alias("place", "beside"))
    met = apart.join(shared, ["component", "after", "place", "beside"]).where(there)
    met = full.unionAll(met.select("id", "start", "component", "after", (F.col("place") + 1).alias("more")))
    more = lambda side: F.coalesce(F.max(F.when(F.col("after") == side, F.col("more"))), F.lit(0))
    reach = met.groupBy("id", "start", "component").agg(more(False).alias("more_before"), more(True).alias("more_after"))
    wide = ends.join(reach, ["id", "start", "component"], "left")
    wide = wide.withColumn("lo", F.col("start") - F.coalesce("more_before", F.lit(0))).withColumn("hi", F.col("end") + F.coalesce("more_after", F.lit(0)))
    return _islands(wide, ["id", "own"], "lo", "hi").drop("end", "more_before", "more_after", "lo", "hi")


def repeated_passages(docs: DataFrame, key: str = "doc_id", text: str = "text", percent: int = 75) -> DataFrame:
    """The paragraphs that documents share: key, first word, number of words, component and whether it is kept.

    `component_id` is the id of the document with the component's first paragraph, and `component_start` its place.
    `passage_start` and `passage_words` are the whole repeated passage that the paragraph is part of, which is what to
    remove where the paragraph is not kept; all paragraphs of a passage name the same one.
    """
    texts = docs.select(F.col(key).cast("bigint").alias("id"), F.col(text).alias("text"))
    cut = settled(paragraphs(texts), "passage-paragraphs")
    every = cut.select("id", "start", "words", "line", "digest")
    classes = every.groupBy("digest").agg(F.min(F.struct("id", "start", "words")).alias("at"), F.max("id").alias("last"))
    classes = settled(classes, "passage-classes")
    release(docs.sparkSession)

    keyed = cut.where("line").groupBy("digest").agg(F.first("keys").alias("keys")).select(F.col("digest").alias("id"), F.explode("keys").alias("bucket"))
    # one pass over a bucket in order says which class is its first and whether there is another one
    bucket = Window.partitionBy("bucket").orderBy("id")
    held = keyed.withColumns({"first": F.first("id").over(bucket), "after": F.lead("id").over(bucket)})
    held = settled(held.where("id <> first OR after <> id").select("bucket", "id", "first"), "passage-buckets")
    release(docs.sparkSession)
    pairs = held.where("id <> first").select(F.col("first").alias("a"), F.col("id").alias("b")).distinct()

    # one place of each class whose words are needed
    needed = classes.join(held.select(F.col("id").alias("digest")).distinct(), "digest", "left_semi")
    places = needed.groupBy(F.col("at.id").alias("id")).agg(F.collect_list(F.struct(F.col("at.start").alias("start"), F.col("at.words").alias("words"), "digest")).alias("places"))
    sets = sets_at(texts.join(places, "id").select("id", "text", "places")).dropDuplicates(["id"])
    sets = settled(sets, "passage-sets")
    release(docs.sparkSession)
    links = settled(confirmed(pairs, sets, percent), "passage-links")
    release(docs.sparkSession)
    members = in_open_buckets(held, components(links, label="passages"))
    met = settled(prefix_pairs(sets.join(members, "id"), percent), "passage-met")
    likeliest = met.groupBy("x", "y").agg(F.max_by(F.struct("a", "b"), F.struct("shared", "a", "b")).alias("pair")).select("pair.*")
    links = settled(links.unionAll(confirmed(likeliest, sets, percent, sized=True)), "passage-links")
    release(docs.sparkSession)
    place = components(links, label="passages")
    apart = met.select("x", "y").distinct()
    for x in ("x", "y"):
        apart = apart.join(place.select(F.col("node").alias(x), F.col("component").alias(f"of_{x}")), x, "left").withColumn(f"of_{x}", F.coalesce(f"of_{x}", x))
    rest = met.join(apart.where("of_x <> of_y").select("x", "y"), ["x", "y"], "left_semi").select("a", "b")
    more = settled(confirmed(rest, sets, percent, sized=True), "passage-links")
    release(docs.sparkSession)
    if not more.isEmpty():
        place = components(links.unionAll(more), label="passages")

    clustered = classes.join(place, F.col("digest") == F.col("node"), "left").where("component IS NOT NULL OR at.id < last")
    rows = every.join(clustered.select("digest", F.coalesce("component", "digest").alias("component")), "digest")
    rows = rows.select("id", "start", "words", "line", "component").distinct()
    first = rows.groupBy("component").agg(F.min(F.struct("id", "start", "words")).alias("first"), F.max("id").alias("last")).where("first.id < last")
    # what begins inside the kept paragraph, in its own document, is part of it and no removal
    own = (F.col("id") == F.col("first.id")) & (F.col("start") < F.col("first.start") + F.col("first.words"))
    rows = settled(rows.join(first.select("component", "first"), "component").withColumn("own", own), "passage-rows")
    discard(cut, classes, held, sets, met, links, more)
    release(docs.sparkSession)
    kept = (F.col("id") == F.col("first.id")) & (F.col("start") == F.col("first.start"))
    out = passages(rows, texts).where(kept | ~F.col("own"))
    return out.select(F.col("id").alias(key), "start", "words", F.col("first.id").alias("component_id"), F.col("first.start").alias("component_start"), kept.alias("kept"),
                      F.col("from").alias("passage_start"), (F.col("to") - F.col("from")).alias("passage_words"))
