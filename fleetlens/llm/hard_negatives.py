"""Hard negatives by inner products in a residue number system.

Components become whole numbers. Each of several small primes takes them to residues small enough that a matrix product
of residues stays below 2^24, where float32 is exact; a longer vector is multiplied in pieces whose products are reduced
before they are added. The product of the primes exceeds twice the largest score that the norms allow, so by the Chinese
remainder theorem the residues of a score determine it, sign included. It is put together digit by digit (each prime
gives one digit of a mixed radix, from -(p-1)/2 to (p-1)/2), in whole numbers throughout.

Anchors meet all rows in blocks. A block of anchors has a bounded number of bytes and is sent to the executors; every
task multiplies it with the rows of its own partition, an Arrow batch at a time, and keeps only what can still be among
an anchor's first rows. Windows over these few rows give the positives; a second pass finds the first rows whose scores
lie in each positive's window. Nothing is grouped by label, so a label that a third of the rows share is no larger task.

Defined results: rows with a null id, label or vector, or with a null or non-finite component, take no part, nor do those
whose squared norm (in whole numbers, summed as doubles) reaches 2^63, as their scores have no place in a long. Vectors of different
lengths have no inner product and never meet; empty vectors have the score 0 with each other. Rows that share an id are
one row, the one with the smallest label and vector. Ties go to the smaller id. An anchor without a positive, or a
positive without a negative in its window, has no row. Further columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetlens.llm.storage import settled

#: Three of them do for unit vectors times 256, nine for scores of 63 bits.
PRIMES = (251, 241, 239, 233, 229, 227, 223, 211, 199, 197)
#: Residues are at most 125, so this many products stay below 2^24.
PIECE = 1024
#: Scores that are computed together.
CELLS = 2_000_000

FIRST = "anchor_id long, vec_id long, score long"
INSIDE = "anchor_id long, positive_id long, negative_id long, positive_score long, negative_score long"
RESULT = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
COLUMNS = [c.split(" ")[0] for c in RESULT.split(", ")]


def primes_for(largest: int) -> tuple[int, ...]:
    """The fewest primes whose residues tell all whole numbers from -largest to largest apart."""
    n, product = 0, 1
    while product <= 2 * largest:
        product *= PRIMES[n]
        n += 1
    return PRIMES[:max(n, 1)]


def residues(values: np.ndarray, primes: tuple[int, ...]) -> list[np.ndarray]:
    """For each prime the residues of whole numbers, nearest to zero, as float32."""
    out = []
    for p in primes:
        r = np.mod(values, p)
        out.append(np.where(r > p // 2, r - p, r).astype(np.float32))
    return out


def product(a: list[np.ndarray], b: list[np.ndarray], primes: tuple[int, ...]) -> np.ndarray:
    """The exact inner products of the rows behind two lists of residues."""
    total, radix, digits = None, 1, []
    for k, p in enumerate(primes):
        r = 0
        for at in range(0, a[k].shape[1], PIECE):
            r = r + (a[k][:, at:at + PIECE] @ b[k][:, at:at + PIECE].T).astype(np.int32) % p
        if a[k].shape[1] == 0:
            r = np.zeros((len(a[k]), len(b[k])), np.int32)
        # the earlier digits' share is taken off, then the radix is divided out
        share, place = 0, 1
        for d, q in zip(digits, primes):
            share = share + d * (place % p)
            place *= q
        digit = (r - share) * pow(radix, -1, p) % p
        digit = np.where(digit > p // 2, digit - p, digit).astype(np.int32)
        digits.append(digit)
        part = digit.astype(np.int64) * np.int64(_wrapped(radix))
        total = part if total is None else total + part  # modulo 2^64, which the result fits in
        radix *= p
    return total


def _wrapped(x: int) -> int:
    return (x + 2**63) % 2**64 - 2**63


def whole(vector: Column, factor: int) -> Column:
    """Components times the factor, rounded down, as doubles."""
    return F.transform(vector, lambda x: F.floor(x.cast("double") * factor).cast("double"))


class _Anchors(NamedTuple):
    """A block of anchors of one length; for the second pass with the windows of their positives."""

    ids: np.ndarray
    labels: np.ndarray
    residues: list[np.ndarray]
    wanted: list[list[tuple[int, int]]] | None


def prepared(rows: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label", factor: int = 256) -> DataFrame:
    """vec_id, label, vector (whole numbers) and its squared norm, of the rows that take part."""
    x = F.col(vector)
    sound = F.col(vec_id).isNotNull() & F.col(label).isNotNull() & x.isNotNull() & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < math.inf))
    # a component of 2^32 alone makes the norm too large, and whole numbers below it are exact as long
    small = F.forall(x, lambda v: F.abs(v.cast("double") * factor) < 2.0**32)
    kept = rows.where(sound).where(small).select(F.col(vec_id).cast("bigint").alias("vec_id"), F.struct(F.col(label).alias("label"), x.alias("v")).alias("row"))
    one = kept.groupBy("vec_id").agg(F.min("row").alias("row")).select("vec_id", "row.label", whole(F.col("row.v"), factor).alias("vector"))
    return one.withColumn("norm", F.aggregate("vector", F.lit(0.0), lambda s, v: s + v * v)).where(F.col("norm") < 2.0**63)


def _batches(batches: Iterator[pd.DataFrame], primes) -> Iterator[tuple[int, np.ndarray, np.ndarray, list[np.ndarray]]]:
    """Rows by the length of their vectors, in order of their ids, with their residues."""
    for batch in batches:
        for size, part in batch.groupby(batch["vector"].map(len), sort=True):
            part = part.sort_values("vec_id")
            matrix = np.array(part["vector"].tolist(), np.float64).reshape(len(part), size)
            yield size, part["vec_id"].to_numpy(), part["label"].to_numpy(), residues(matrix, primes)


def _tiles(anchors: dict[int, _Anchors], batches, primes) -> Iterator[tuple[_Anchors, int, np.ndarray, np.ndarray, np.ndarray]]:
    """Anchors, the place of the first of them in this tile, and the ids, labels and scores of the rows of a batch."""
    for size, ids, labels, res in _batches(batches, primes):
        if size in anchors:
            block = anchors[size]
            step = max(1, CELLS // len(ids))
            for at in range(0, len(block.ids), step):
                yield block, at, ids, labels, product([r[at:at + step] for r in block.residues], res, primes)


def _best(scores: np.ndarray, allowed: np.ndarray, n: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows and columns of the highest allowed score of every row, then of the next, up to `n`; ties to the left."""
    low = np.iinfo(np.int64).min
    left = np.where(allowed, scores, low)
    every = np.arange(len(scores))
    for _ in range(min(n, scores.shape[1])):
        at = left.argmax(axis=1)
        there = left[every, at] > low
        if not there.any():
            return
        yield every[there], at[there]
        left[every, at] = low


def _first_rows(rows: DataFrame, block, primes, n: int) -> DataFrame:
    """For each anchor the first `n` other rows of its label within every batch."""

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for a, at, ids, labels, scores in _tiles(block.value, batches, primes):
            mine, my_labels = a.ids[at:at + len(scores)], a.labels[at:at + len(scores)]
            allowed = (labels[None, :] == my_labels[:, None]) & (ids[None, :] != mine[:, None])
            for r, c in _best(scores, allowed, n):
                yield pd.DataFrame({"anchor_id": mine[r], "vec_id": ids[c], "score": scores[r, c]})

    return rows.mapInPandas(scan, FIRST)


def _rows_inside(rows: DataFrame, block, primes, window: tuple[int, int], n: int) -> DataFrame:
    """For each anchor and positive the first `n` rows of other labels within the positive's window, in every batch."""
    lower, upper = window

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for a, at, ids, labels, scores in _tiles(block.value, batches, primes):
            mine, my_labels, wanted = a.ids[at:at + len(scores)], a.labels[at:at + len(scores)], a.wanted[at:at + len(scores)]
            other = labels[None, :] != my_labels[:, None]
            for k in range(max(map(len, wanted))):
                has = np.flatnonzero([len(w) > k for w in wanted])
                positive, value = (np.array([wanted[i][k][x] for i in has], np.int64) for x in (0, 1))
                # lower * positive <= 100 * negative <= upper * positive, solved for the negative in whole numbers
                least = np.array([-(-lower * int(v) // 100) for v in value], np.int64)
                most = np.array([upper * int(v) // 100 for v in value], np.int64)
                s = scores[has]
                for r, c in _best(s, other[has] & (s >= least[:, None]) & (s <= most[:, None]), n):
                    yield pd.DataFrame({"anchor_id": mine[has[r]], "positive_id": positive[r], "negative_id": ids[c], "positive_score": value[r], "negative_score": s[r, c]})

    return rows.mapInPandas(scan, INSIDE)


def _ranked(df: DataFrame, scope: list[str], score: str, vec_id: str, n: int) -> DataFrame:
    """The first `n` rows of a scope, over the partial results of all tasks, with their rank."""
    w = Window.partitionBy(*scope).orderBy(F.col(score).desc(), F.col(vec_id))
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def _block(found: list, primes, wanted: dict[int, list[tuple[int, int]]] | None = None) -> dict[int, _Anchors]:
    by_size: dict[int, list] = {}
    for r in sorted(found, key=lambda r: r["vec_id"]):
        if wanted is None or r["vec_id"] in wanted:
            by_size.setdefault(len(r["vector"]), []).append(r)
    return {size: _Anchors(np.array([r["vec_id"] for r in rows], np.int64), np.array([r["label"] for r in rows]),
                           residues(np.array([r["vector"] for r in rows], np.float64).reshape(len(rows), size), primes),
                           None if wanted is None else [wanted[r["vec_id"]] for r in rows]) for size, rows in by_size.items()}


def mine(rows: DataFrame, anchor: Column, positives: int = 5, negatives: int = 3, window: tuple[int, int] = (50, 95), factor: int = 256,
         vec_id: str = "vec_id", vector: str = "embedding", label: str = "label", block_mb: float = 48) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score and negative_score.

    `anchor` is a condition on vec_id that names the anchors. Their `positives` are the first other rows of their label;
    for each of them the first `negatives` rows of other labels score from `window[0]` to `window[1]` percent of it.
    A block of anchors has about `block_mb` megabytes as float64, whatever their number; every block is one pass over
    the rows for the positives and one for the negatives, and its result is written before the next one begins.
    """
    spark = rows.sparkSession
    table = settled(prepared(rows, vec_id, vector, label, factor), "hard-negatives-rows")
    anchors = table.where(anchor)
    n_bytes, largest_anchor = anchors.agg(F.sum(8 * F.size("vector") + 64), F.max("norm")).first()
    if n_bytes is None:
        return spark.createDataFrame([], RESULT)
    largest = table.agg(F.max("norm")).first()[0]
    # by Cauchy and Schwarz no score exceeds the product of two norms; the factor is for their rounding
    primes = primes_for(int(math.sqrt(largest_anchor) * math.sqrt(largest) * (1 + 1e-9)) + 1)
    blocks = math.ceil(n_bytes / (block_mb * 2**20))
    done = []
    for k in range(blocks):
        found = anchors.where(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == k).select("vec_id", "label", "vector").collect()
        if not found:
            continue
        sent = spark.sparkContext.broadcast(_block(found, primes))
        first = _ranked(_first_rows(table, sent, primes, positives), ["anchor_id"], "score", "vec_id", positives)
        wanted: dict[int, list[tuple[int, int]]] = {}
        for r in first.orderBy("anchor_id", "rank").collect():  # `positives` rows an anchor of the block
            wanted.setdefault(r["anchor_id"], []).append((r["vec_id"], r["score"]))
        sent.unpersist()
        if not wanted:
            continue
        sent = spark.sparkContext.broadcast(_block(found, primes, wanted))
        inside = _ranked(_rows_inside(table, sent, primes, window, negatives), ["anchor_id", "positive_id"], "negative_score", "negative_id", negatives)
        done.append(settled(inside.select(*COLUMNS), "hard-negatives"))
        sent.unpersist()
    if not done:
        return spark.createDataFrame([], RESULT)
    return reduce(DataFrame.unionAll, done)
