"""Mixing sources to target weights by entropy balancing.

Every document gets a rate, how often the mix takes it. Among all rates that give each source its target of words,
those nearest to 1 (least relative entropy, weighted by words) are exponentials of one multiplier a source,
`rate = exp(lambda)`; the multipliers minimise the convex dual `sum(size * exp(lambda)) - sum(lambda * target)`.
Newton's method finds them: gradient and curvature of the dual are sums over documents, which Spark forms once a
source with map-side combine, as every document of a source has the same exponent; so an iteration reads one row a
source, whatever the documents.

Rates become copies: a document has `floor(rate)` copies for certain and one more by its share of chance, a hash of
its key. To meet a target in words and not on average only, the chance is steered by size: sources go from their
largest size class (a power of two) to the smallest, and each class aims at what is still missing, choosing from the
hash histogram of its words the threshold that comes nearest. So a long document that came in or stayed out is
made good by the shorter ones after it. One source's histogram has at most 63 classes of 256 bins, whatever its
documents; no source is ever sorted or gathered.

Defined results: a null or empty text has size 0 and is taken 0 words (its copies follow the rate and cost nothing).
A null source is a source of its own, after all others. A source without words has target 0. Repeated rows are taken
each by its own hash of key, text size and source, so equal rows share their fate. Further columns are kept; one whose
name a result column has is replaced. An empty table gives an empty mix.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetlens.llm.storage import settled
from fleetlens.llm.text import BLANK_RUN, plus_columns, unused

RESULT = ("size", "source_size", "target", "rate", "copies", "taken")
BINS = 256
NEWTON_STEPS = 40


def size_of(text: Column) -> Column:
    """The number of words."""
    n = F.size(F.split(F.coalesce(text, F.lit("")), BLANK_RUN))
    edge = lambda pattern: F.when(text.rlike(pattern), 1).otherwise(0)
    return (n - F.when(F.coalesce(text, F.lit("")) == "", 1).otherwise(edge(rf"\A{BLANK_RUN}") + edge(rf"{BLANK_RUN}\z"))).cast("bigint")


def targets(sizes: DataFrame, weights: Sequence[int], most: int) -> DataFrame:
    """`target` of every row of (source, source_size): its share of all words by weight, at most `most` times its size.

    Weights go round the sources in order of code point, null last. What a bound cuts off is shared again by weight
    among the others until none is above: the level L with sum(min(most * size, weight * L)) = all words. Sources in
    order of bound over weight meet the level one after the other, so running totals find it without a loop. The
    windows here read one row a source.
    """
    order = Window.orderBy(F.col("source").isNull(), F.col("source").cast("binary"))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int"))
    rows = sizes.withColumn("weight", weight).withColumn("bound", F.col("source_size").cast("double") * most)
    filling = Window.orderBy(F.col("bound") / F.col("weight"), F.col("source").isNull(), F.col("source").cast("binary"))
    before = filling.rowsBetween(Window.unboundedPreceding, -1)
    onward = filling.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everything = Window.partitionBy()
    rows = rows.withColumns({
        "total": F.sum(F.col("source_size").cast("double")).over(everything), "full": F.coalesce(F.sum("bound").over(before), F.lit(0.0)),
        "rest": F.sum("weight").over(onward), "fill": F.col("bound") / F.col("weight")})
    # the level if this source and those after it are not bounded; the first source for which that holds decides
    own = (F.col("total") - F.col("full")) / F.col("rest")
    rows = rows.withColumns({"own": own, "place": F.row_number().over(filling)})
    level = F.min(F.when(F.col("own") <= F.col("fill"), F.struct("place", "own"))).over(everything)["own"]
    return rows.select("source", "source_size", F.least("bound", F.col("weight") * level).alias("target"))


def multipliers(moments: DataFrame) -> DataFrame:
    """`rate = exp(lambda)` of every row of (source_size, target), by Newton steps on the dual from lambda = 0.

    A step is at most 1 upward, so that no exponential runs away; where the target is 0 the rate is 0.
    """
    size, target = F.col("source_size").cast("double"), F.col("target")

    def step(value: Column, _) -> Column:
        gradient, curvature = size * F.exp(value) - target, size * F.exp(value)
        return value - F.greatest(gradient / curvature, F.lit(-1.0))

    solved = F.aggregate(F.sequence(F.lit(1), F.lit(NEWTON_STEPS)), F.lit(0.0), step)
    return moments.withColumn("lambda", F.when((target > 0) & (size > 0), solved)).withColumn("rate", F.coalesce(F.exp("lambda"), F.lit(0.0)))


def _cuts(histogram: pd.DataFrame) -> pd.DataFrame:
    """For one source: by size class, the bin below which a document gets one copy more."""
    rate, target = float(histogram["rate"].iloc[0]), float(histogram["target"].iloc[0])
    sure = int(np.floor(rate + 1e-9))
    missing = target - sure * float(histogram["words"].sum())
    out = []
    left = float(histogram["words"].sum())
    for k in sorted(histogram["class"].unique(), reverse=True):
        part = histogram[histogram["class"] == k]
        words = np.zeros(BINS)
        words[part["bin"].to_numpy()] = part["words"].to_numpy()
        reached = np.concatenate([[0.0], np.cumsum(words)])
        share = 0.0 if left <= 0 else min(1.0, max(0.0, missing / left))
        # the last class takes what comes nearest to all that is missing, the others their share of it
        aim = share * reached[-1]
        cut = int(np.argmin(np.abs(reached - aim)))
        missing -= reached[cut]
        left -= reached[-1]
        out.append((int(k), cut, sure))
    return pd.DataFrame(out, columns=["class", "cut", "sure"])


def mix(docs: DataFrame, weights: Sequence[int], key: str = "doc_id", text: str = "text", source: str = "source", most: int = 3) -> DataFrame:
    """Every document with its size, its source's size and target, its rate, its copies and the words taken."""
    src, size, dice, kind, bin_ = unused([*docs.columns, *RESULT, "cut", "sure"], "_source", "_size", "_dice", "_class", "_bin")
    rows = docs.withColumns({size: size_of(F.col(text)), src: F.col(source)})
    rows = rows.withColumn(dice, F.xxhash64(F.col(key).cast("string"), F.col(size), F.col(src)))
    rows = rows.withColumns({kind: F.floor(F.log2(F.greatest(F.col(size), F.lit(1)))).cast("int"), bin_: F.pmod(F.col(dice), F.lit(BINS)).cast("int")})
    # one pass over the texts: per source at most 63 classes of 256 bins
    fine = rows.groupBy(F.col(src).alias("source"), F.col(kind).alias("class"), F.col(bin_).alias("bin")).agg(F.sum(size).alias("words"))
    fine = settled(fine, "mix-histogram")
    sizes = fine.groupBy("source").agg(F.sum("words").alias("source_size"))
    rates = settled(multipliers(targets(sizes, weights, most)).select("source", "source_size", "target", "rate"), "mix-rates")
    with_rate = fine.join(rates, fine["source"].eqNullSafe(rates["source"])).select(rates["source"], "class", "bin", "words", "rate", "target")

    def cuts(histogram: pd.DataFrame) -> pd.DataFrame:
        out = _cuts(histogram)
        out.insert(0, "source", histogram["source"].iloc[0])
        return out

    steered = with_rate.groupBy("source").applyInPandas(cuts, "source string, class int, cut int, sure int")
    plan = settled(steered.join(rates, steered["source"].eqNullSafe(rates["source"])).select(steered["source"], "class", "cut", "sure", "source_size", "target", "rate"), "mix-plan")
    # at most 63 rows a source; adaptive execution splits the side of a hot source
    names = {x: f"_mix_{x}" for x in plan.columns}
    plan = plan.select(*[F.col(x).alias(y) for x, y in names.items()])
    out = rows.join(plan, rows[src].eqNullSafe(plan["_mix_source"]) & (rows[kind] == plan["_mix_class"]), "left")
    copies = (F.col("_mix_sure") + F.when(F.col(bin_) < F.col("_mix_cut"), 1).otherwise(0)).cast("int")
    return out.select(*[F.col(f"`{c}`") for c in plus_columns(docs.columns, list(RESULT))], F.col(size).alias("size"), F.col("_mix_source_size").alias("source_size"),
                      F.col("_mix_target").alias("target"), F.col("_mix_rate").alias("rate"), copies.alias("copies"), (copies * F.col(size)).cast("bigint").alias("taken"))
