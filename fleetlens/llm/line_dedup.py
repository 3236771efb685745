"""Line deduplication by deletion neighbourhoods, in DataFrame functions alone.

A line goes when an earlier line (by document, then by line number) equals it or is within one edit of it: a
character inserted, deleted or replaced. Equal lines meet by a 128-bit digest. For the others, two lines are within one
edit exactly when one is a deletion variant of the other, or both have the same variant with the same place deleted.

Emitting all variants of all lines would cost the square of a line's length, and nearly all of them meet nothing. So a
line first emits coarse variants, which leave out a block and not a character: one edit lies in one block, and everything
in front of it (counted from the start) and behind it (counted from the end) is equal. Lines whose coarse variant nobody
shares are done, without any loss; the others go on inside the block, first of half a line, then of a sixteenth,
until a block has at most 20 characters. Its deletion variants are the keys then. Lines one character apart in length meet
under the shorter length, which every line emits besides its own.

Only minima are formed by key, never pairs: all lines with one variant at one place are within one edit of each other, so
the earliest of them decides for all; and a line that is itself a variant is within one edit of all lines that have it.
The edit distance to that earliest line is verified in the end. Copies of a line are one line after the first step,
so a line that a third of the documents have is one row from there on.

Lines of fewer than 20 characters only go when they are equal, as one edit makes another word of them. Lines without a
word always stay.

Defined results: a null text has no lines, an empty one a single line without a word. Rows that share an id share their
places: their line numbers count from 0 each. A null id comes before all others. An empty table gives an empty result.
`without_repeated_lines` keeps all columns; a document of which all lines with words go is left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetlens.llm.storage import settled
from fleetlens.llm.text import unused

SHORTEST = 20
LEAF = 20
PARTS = 16
DIGEST = ("h1", "h2")


def _lines(docs: DataFrame, key: str, text: str) -> DataFrame:
    """Every line with a word: its document, number and text."""
    rows = docs.select(F.col(key).alias("doc"), F.posexplode(F.split(F.col(text), "\n")).alias("line_no", "line"))
    return rows.where(F.col("line").rlike(r"[^\x20\x09-\x0D]"))


def _digest(line: Column) -> list[Column]:
    return [F.xxhash64(line).alias("h1"), F.xxhash64(F.lit(1), line).alias("h2")]


def _blocks(line: Column, halves: bool = False) -> Column:
    """The coarse variants of a line: for its own length and the one below, the line in two halves or in blocks of some 20 characters.

    Each has the digest of the length, the block's number and all that lies around the block; the place of the block;
    and `base`, the block's size in a line of that very length. All of one digest have the same base, and so take the
    same way from here on.
    """
    n = F.length(line)

    def parts(m: Column) -> Column:
        return F.lit(2) if halves else F.least(F.ceil((m + 1) / LEAF), F.lit(PARTS)).cast("int")

    def block(m: Column, i: Column) -> Column:
        begin, end = (i * m / parts(m)).cast("int"), ((i + 1) * m / parts(m)).cast("int")
        behind = m - end
        return F.struct(F.xxhash64(m, i, F.substring(line, F.lit(1), begin), F.lit(-1), F.substring(line, n - behind + 1, behind)).alias("around"),
                        (begin + 1).alias("begin"), (n - behind - begin).alias("size"), (end - begin).alias("base"))

    return F.flatten(F.transform(F.array(n, n - 1), lambda m: F.transform(F.sequence(F.lit(0), parts(m) - 1), lambda i: block(m, i))))


def _shared(rows: DataFrame) -> DataFrame:
    """The groups of rows (group, h1) that hold two lines."""
    return rows.groupBy("group").agg(F.min("h1").alias("x"), F.max("h1").alias("y")).where("x <> y").select("group")


def _coarse(docs: DataFrame, lines: DataFrame, key: str, text: str) -> DataFrame:
    """The halves (group, digest, block) in which a long line may differ by an edit from another."""
    keyed = lines.select("doc", "line_no", *DIGEST, F.posexplode("halves").alias("which", "group"))
    met = keyed.join(_shared(keyed), "group").groupBy(*DIGEST, "group", "which").agg(F.min(F.struct("doc", "line_no")).alias("at"))
    wanted = met.groupBy(F.col("at.doc").alias("wanted_doc")).agg(F.collect_list(F.struct(F.col("at.line_no").alias("line_no"), *DIGEST, "group", "which")).alias("wanted"))
    texts = docs.select(F.col(key).alias("doc"), F.split(F.col(text), "\n").alias("lines"))
    rows = texts.join(wanted, F.col("doc").eqNullSafe(F.col("wanted_doc"))).select(
        F.explode(F.transform("wanted", lambda w: F.struct(w.alias("w"), F.get(F.col("lines"), w["line_no"]).alias("line")))).alias("x"))
    # rows that share an id may hold another line at that place
    rows = rows.where(F.xxhash64("x.line") == F.col("x.w.h1")).select("x.w.*", "x.line")
    half = F.get(_blocks(F.col("line"), halves=True), F.col("which"))
    rows = rows.select("group", *DIGEST, "line", half.alias("half"))
    return rows.select("group", *DIGEST, F.substring(F.col("line"), F.col("half.begin"), F.col("half.size")).alias("block"), "half.base")


def _finer(blocks: DataFrame) -> DataFrame:
    """The same inside blocks: their own blocks that are shared."""
    rows = blocks.select("group", *DIGEST, "block", F.explode(_blocks(F.col("block"))).alias("x"))
    rows = rows.select(F.xxhash64("group", "x.around").alias("group"), *DIGEST, F.substring(F.col("block"), F.col("x.begin"), F.col("x.size")).alias("block"), "x.base")
    return rows.join(_shared(rows), "group").distinct()


def _variants(block: Column) -> Column:
    """The deletion neighbourhood of a block: (key, role) with role `whole`, `less` (a character deleted) or `place` (deleted at a place)."""
    n = F.length(block)
    places = F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>"))
    less = lambda p: F.concat(F.substring(block, F.lit(1), p - 1), F.substring(block, p + 1, n))
    entry = lambda role, *of: F.struct(F.xxhash64(*of).alias("key"), F.lit(role).alias("role"))
    return F.concat(F.array(entry("whole", F.lit(0), block)), F.transform(places, lambda p: entry("less", F.lit(0), less(p))),
                    F.transform(places, lambda p: entry("place", p, n, less(p))))


def _earlier_within_one_edit(leaves: DataFrame, firsts: DataFrame) -> DataFrame:
    """For lines (h1, h2) the earliest other line within one edit, where it is earlier."""
    rows = leaves.join(firsts, list(DIGEST)).select("group", *DIGEST, "first", "block", F.explode(_variants(F.col("block"))).alias("v"))
    rows = settled(rows.select(F.xxhash64("group", "v.key").alias("key"), "v.role", *DIGEST, "first", "block"), "line-variants")
    one = F.struct("first", "block")
    least = rows.groupBy("key").agg(*[F.min(F.when(F.col("role") == role, one)).alias(role) for role in ("whole", "less", "place")])
    least = least.where("place IS NOT NULL OR (whole IS NOT NULL AND less IS NOT NULL)")
    found = rows.join(least, "key").select(
        *DIGEST, "first", "block", F.when(F.col("role") == "whole", F.col("less")).when(F.col("role") == "less", F.col("whole")).otherwise(F.col("place")).alias("other"))
    found = found.where((F.col("other.first") < F.col("first")) & (F.levenshtein("block", "other.block", 1) >= 0))
    return found.groupBy(*DIGEST).agg(F.min("other.first").alias("near"))


def repeated_lines(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Every line with a word: key, `line_no` (from 0), the place of the earliest line that equals it or is within one
    edit of it (its own place, if there is none before it), and whether the line is kept."""
    lines = _lines(docs, key, text)
    halves = F.when(F.length("line") >= SHORTEST, F.transform(_blocks(F.col("line"), halves=True), lambda x: x["around"]))
    lines = settled(lines.select("doc", "line_no", *_digest(F.col("line")), halves.alias("halves")), "lines")
    firsts = settled(lines.groupBy(*DIGEST).agg(F.min(F.struct("doc", "line_no")).alias("first")), "line-firsts")

    blocks = settled(_coarse(docs, lines, key, text), "line-blocks")
    leaves = blocks.where(F.col("base") <= LEAF)
    long = blocks.where(F.col("base") > LEAF)
    while not long.isEmpty():
        blocks = settled(_finer(long), "line-blocks")
        leaves = leaves.unionAll(blocks.where(F.col("base") <= LEAF))
        long = blocks.where(F.col("base") > LEAF)

    near = _earlier_within_one_edit(leaves, firsts)
    earliest = firsts.join(near, list(DIGEST), "left").select(*DIGEST, F.least("first", F.coalesce("near", "first")).alias("earliest"))
    out = lines.select("doc", "line_no", *DIGEST).join(earliest, list(DIGEST))
    kept = F.struct("doc", "line_no").eqNullSafe(F.col("earliest"))
    return out.select(F.col("doc").alias(key), "line_no", F.col("earliest.doc").alias("earlier_id"), F.col("earliest.line_no").alias("earlier_line"), kept.alias("kept"))


def without_repeated_lines(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents without the lines that `repeated_lines` does not keep, all columns as they were."""
    id_, flags, lines = unused(docs.columns, "_id", "_flags", "_lines")
    judged = repeated_lines(docs, key, text).select(F.col(key).alias(id_), "line_no", "kept")
    # a flag for every line, those without a word too, so that a line finds its own by number
    places = docs.select(F.col(key).alias(id_), F.posexplode(F.split(F.col(text), "\n")).alias("line_no", "line")).select(id_, "line_no", F.lit(True).alias("kept"))
    each = judged.unionAll(places).groupBy(id_, "line_no").agg(F.bool_and("kept").alias("kept"))
    per = each.groupBy(id_).agg(F.array_sort(F.collect_list(F.struct("line_no", "kept"))).alias(flags), F.bool_and("kept").alias("all"))
    gone = per.where("NOT all").select(id_, F.transform(flags, lambda x: x["kept"]).alias(flags))
    out = docs.join(gone, docs[key].eqNullSafe(gone[id_]), "left")
    kept = F.filter(F.split(F.col(text), "\n"), lambda line, i: F.coalesce(F.get(F.col(flags), i), F.lit(True)))
    has_word = lambda t: t.rlike(r"[^\x20\x09-\x0D]")
    out = out.withColumn(lines, F.when(F.col(flags).isNull(), F.col(text)).otherwise(F.array_join(kept, "\n")))
    out = out.where(F.col(flags).isNull() | has_word(F.col(lines)))
    return out.select(*[(F.col(lines).alias(text) if c == text else docs[c]) for c in docs.columns])
