"""Toxicity by non-negative learning from positive and unlabelled texts.

Only confirmed toxic texts are examples of a class; every other text is unlabelled, be it marked harmless or not marked
at all. With the share `prior` of toxic texts among the unlabelled ones, the risk of a classifier on harmless texts is
its negative-class risk on unlabelled texts less `prior` times that on toxic ones. Where this estimate falls below zero,
which a true risk cannot, the classifier has begun to learn the unlabelled toxic texts by heart, and the step goes the
other way.

Features are the distinct words of a text and the distinct runs of five bytes in or at the border of a word, hashed.
The same correction gives each feature's rate in harmless texts; features whose rate in toxic texts is surely higher are
kept, scaled by the logarithm of the ratio. Weights are never negative, so harmless text around a toxic passage does not
hide it, whatever the length.

Several classifiers are trained side by side, one task each, every one from its own bounded sample of distinct texts;
the mean of their logits decides. Scoring reads every text whole, in one pass without a shuffle.

Defined results: null and empty texts have no features and get the score of the bias alone; so do all texts, with score
0, when nothing toxic was confirmed. Repeated rows get equal scores; repeated texts count once in learning, as toxic
where one of them is confirmed. A key that is labelled several times is toxic if one label says so; null keys and null
labels mark nothing. Ties between features go to the smaller hash. Further columns are kept, and one whose name a result
column has is replaced by it. A very long text is worked on alone.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetlens.llm.shingles import mixed
from fleetlens.llm.storage import settled
from fleetlens.llm.text import plus_columns, unused

RESULT = "score double, predicted int"
WORD = re.compile(r"[^\W\d_]+")
RUN = 5
BITS = 20
#: Characters whose features are taken together; a task holds some 60 bytes for each.
PART = 500_000

_PLACES = mixed(np.arange(1, RUN + 1, dtype=np.uint64)) | np.uint64(1)


class Model(NamedTuple):
    """The mean of the trained classifiers: feature hashes in ascending order, their weights, and the bias."""

    features: np.ndarray
    weights: np.ndarray
    bias: float


def features_of(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """The number of a text and the hash of a feature, for every occurrence of every feature."""
    framed = [(" " + " ".join(WORD.findall((t or "").lower())) + " ").encode() for t in texts]
    b = np.frombuffer(b"".join(framed), np.uint8)
    doc = np.repeat(np.arange(len(texts)), [len(x) for x in framed])
    blank = b == 32
    start = np.flatnonzero(~blank & np.roll(blank, 1))
    if not len(start):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    value = b.astype(np.uint64)
    place = np.arange(len(b)) - np.maximum.accumulate(np.where(blank, np.arange(len(b)), 0))
    letter = np.where(blank, np.uint64(0), mixed(value + place.astype(np.uint64) * np.uint64(256)))
    words = mixed(np.add.reduceat(letter, start))
    n = len(b) - RUN + 1
    inside = blank[1:1 + n] | blank[2:2 + n] | blank[3:3 + n]
    at = np.flatnonzero(~inside)
    runs = mixed(sum(value[at + k] * _PLACES[k] for k in range(RUN)) + np.uint64(RUN))
    hashes = np.concatenate([words, runs]) >> np.uint64(64 - BITS)
    return np.concatenate([doc[start], doc[at]]), hashes.astype(np.int64)


def _parts(texts: list[str | None]) -> Iterator[list[str | None]]:
    part, chars = [], 0
    for t in texts:
        if part and chars + len(t or "") > PART:
            yield part
            part, chars = [], 0
        part.append(t)
        chars += len(t or "")
    if part:
        yield part


def feature_sets(texts: list[str | None]) -> list[np.ndarray]:
    """The distinct features of each text."""
    out = []
    for part in _parts(texts):
        doc, feature = features_of(part)
        both = np.unique((doc << BITS) | feature)
        out += np.split((both & ((1 << BITS) - 1)).astype(np.int32), np.searchsorted(both >> BITS, np.arange(1, len(part))))
    return out


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit(toxic: list[np.ndarray], unlabelled: list[np.ndarray], prior: float, certainty: float = 3.0, seen: int = 3,
        most: int = 20_000, steps: int = 200, rate: float = 0.1, sparsity: float = 1e-3) -> tuple[np.ndarray, np.ndarray, float]:
    """One classifier from feature sets: its features, weights and bias.

    A feature is kept where at least `seen` toxic texts have it and its rate in them exceeds the corrected rate in
    harmless texts by `certainty` standard errors; at most `most` features, those that exceed it most.
    """
    n_toxic, n_unlabelled = len(toxic), len(unlabelled)
    n = 1 << BITS
    count = lambda sets: np.bincount(np.concatenate(sets), minlength=n) if sets else np.zeros(n, np.int64)
    in_toxic = count(toxic)
    p = in_toxic / max(n_toxic, 1)
    q = np.maximum(count(unlabelled) / max(n_unlabelled, 1) - prior * p, 0) / (1 - prior)
    least_p, least_q = 0.5 / max(n_toxic, 1), 0.5 / max(n_unlabelled, 1)
    error = np.sqrt((p * (1 - p) + least_p) / max(n_toxic, 1) + (np.minimum(q, 1) * (1 - np.minimum(q, 1)) + least_q) / max(n_unlabelled, 1))
    above = (p - q) / error
    kept = np.flatnonzero((in_toxic >= seen) & (above > certainty))
    if len(kept) > most:
        kept = np.sort(kept[np.argsort(-above[kept], kind="stable")[:most]])
    scale = np.log((p[kept] + least_p) / (q[kept] + least_q))
    slot = np.full(n, -1, np.int32)
    slot[kept] = np.arange(len(kept))

    def entries(sets):
        slots = [s[s >= 0] for s in (slot[x] for x in sets)]
        return np.concatenate(slots), np.repeat(np.arange(len(slots)), [len(s) for s in slots])

    (ti, td), (ui, ud) = entries(toxic), entries(unlabelled)
    w, bias = np.zeros(len(kept)), float(np.log(prior / (1 - prior)))
    w_past, bias_past = np.full(len(kept), 1e-8), 1e-8
    for _ in range(steps):
        t = np.bincount(td, (w * scale)[ti], n_toxic) + bias
        u = np.bincount(ud, (w * scale)[ui], n_unlabelled) + bias
        harmless_risk = np.logaddexp(0, u).mean() - prior * np.logaddexp(0, t).mean()
        if harmless_risk >= 0:  # the toxic part and the corrected harmless part of the risk
            dt, du = np.full(n_toxic, -prior / n_toxic), _sigmoid(u) / n_unlabelled
        else:  # back to where the estimate is no longer negative
            dt, du = prior * _sigmoid(t) / n_toxic, -_sigmoid(u) / n_unlabelled
        dw = (np.bincount(ti, dt[td], len(kept)) + np.bincount(ui, du[ud], len(kept))) * scale
        db = dt.sum() + du.sum()
        w_past += dw * dw
        bias_past += db * db
        step = rate / np.sqrt(w_past)
        w = np.maximum(w - step * (dw + sparsity), 0)
        bias -= rate / np.sqrt(bias_past) * db
    used = np.flatnonzero(w > 0)
    return kept[used], (w * scale)[used], float(bias)


def learn(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", label: str = "toxic", toxic: int = 3000,
          unlabelled: int = 9000, members: int = 3, prior: float | None = None) -> Model | None:
    """The model from `docs` and the `labels` of their keys; None where nothing toxic is confirmed.

    Each of the `members` classifiers takes some `toxic` confirmed and `unlabelled` other distinct texts, all where
    there are fewer, by a hash of the text. Where no `prior` is given it follows from the labels: they are taken for a
    random sample, and its toxic share, less the confirmed texts, is that of the rest. Only keys and hashes of all texts
    are shuffled; the texts of the samples go to one task a classifier, and the trained weights to the driver.
    """
    marks = labels.where(F.col(key).isNotNull() & F.col(label).isNotNull()).groupBy(F.col(key).alias("key")).agg(F.max(F.col(label) == 1).alias("toxic"))
    rows = docs.where(F.col(text).isNotNull()).select(F.col(key).alias("key"), F.col(text).alias("text"), F.xxhash64(F.col(text)).alias("h"))
    known = settled(rows.select("key", "h").join(marks, "key", "left").groupBy("h").agg(F.max("toxic").alias("toxic")), "toxicity-texts")
    n, n_toxic, n_marked = known.agg(F.count(F.lit(1)), F.count_if("toxic"), F.count("toxic")).first()
    if not n_toxic:
        return None
    if prior is None:
        share, marked = n_toxic / n_marked, n_marked / n
        prior = share * (1 - marked) / (1 - share * marked)
    prior = min(max(prior, 1e-4), 1 - 1e-4)

    confirmed = F.coalesce("toxic", F.lit(False))
    bound = F.when(confirmed, toxic / n_toxic).otherwise(unlabelled / max(n - n_toxic, 1))
    dice = lambda m: F.shiftrightunsigned(F.xxhash64("h", F.lit(m)), 11) / F.lit(float(1 << 53))
    taken = known.select("h", confirmed.alias("toxic"), F.filter(F.array(*[F.when(dice(m) < bound, F.lit(m)) for m in range(members)]), F.isnotnull).alias("members"))
    # some members * (toxic + unlabelled) rows of numbers, whatever the input
    chosen = rows.join(F.broadcast(taken.where(F.size("members") > 0)), "h").groupBy("h", "toxic", "members").agg(F.min("text").alias("text"))

    def train(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("h")
        sets = [feature_sets(list(group["text"][group["toxic"] == kind])) for kind in (True, False)]
        features, weights, bias = fit(*sets, prior) if all(sets) else ([], [], -30.0)
        return pd.DataFrame({"member": [group["member"].iloc[0]], "features": [list(features)], "weights": [list(weights)], "bias": [bias]})

    fitted = (chosen.select("h", "toxic", "text", F.explode("members").alias("member")).groupBy("member")
              .applyInPandas(train, "member int, features array<bigint>, weights array<double>, bias double"))
    found = sorted(fitted.collect())  # one row a classifier, of bounded length
    weight = np.zeros(1 << BITS)
    for row in found:
        np.add.at(weight, np.array(row["features"], np.int64), np.array(row["weights"], float) / len(found))
    features = np.flatnonzero(weight)
    return Model(features, weight[features], float(np.mean([row["bias"] for row in found])) if found else -30.0)


@functools.lru_cache(maxsize=1)
def _table(features: bytes, weights: bytes) -> np.ndarray:
    table = np.zeros(1 << BITS)
    table[np.frombuffer(features, np.int64)] = np.frombuffer(weights)
    return table


def logits(texts: list[str | None], model: Model) -> np.ndarray:
    table = _table(model.features.tobytes(), model.weights.tobytes())
    out = []
    for part in _parts(texts):
        doc, feature = features_of(part)
        hit = np.flatnonzero(table[feature])
        both = np.unique((doc[hit] << BITS) | feature[hit])
        out.append(np.bincount(both >> BITS, table[both & ((1 << BITS) - 1)], len(part)) + model.bias)
    return np.concatenate(out) if out else np.zeros(0)


def score(docs: DataFrame, model: Model | None, text: str = "text") -> DataFrame:
    """Every row with the score of its text, from 0 to 1, and whether it is 0.5 or more."""
    names = [f.split(" ")[0] for f in RESULT.split(", ")]
    columns = [F.col(f"`{c}`") for c in plus_columns(docs.columns, names)]
    if model is None:
        return docs.select(*columns, F.lit(0.0).alias("score"), F.lit(0).alias("predicted"))
    sent = docs.sparkSession.sparkContext.broadcast(model)  # at most `members * most` features

    @F.pandas_udf("double")
    def judged(texts: pd.Series) -> pd.Series:
        return pd.Series(_sigmoid(logits(list(texts), sent.value)))

    (found,) = unused(docs.columns, "_score")
    out = docs.withColumn(found, judged.asNondeterministic()(F.col(text)))
    return out.select(*columns, F.col(found).alias("score"), F.when(F.col(found) >= 0.5, 1).otherwise(0).alias("predicted"))


def held_out(key: Column) -> Column:
    """The fifth of the documents whose labels learning leaves out; a null key is not among it."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 5 == 0, F.lit(False))
