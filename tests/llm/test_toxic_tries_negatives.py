"""op11, op12 and op13 on small frames: against brute force, and held-out accuracy."""

import hashlib
import math
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from fleetlens.llm import prefix_trie as trie
from fleetlens.llm.hard_negatives import mine, primes_for, product, residues
from fleetlens.llm.toxicity import Model, feature_sets, features_of, fit, held_out, learn, logits, score

# --- op11 ---

TOXIC = ["vilewort", "gruntzeb", "moxfaul"]


def corpus(n, seed=5):
    """(doc_id, text, toxic): toxic texts have words of three stems among harmless invented ones."""
    dice = random.Random(seed)
    plain = ["".join(dice.choice("aeioulnrst") for _ in range(dice.randrange(2, 8))) for _ in range(500)]
    out = []
    for i in range(n):
        words = [dice.choice(plain) for _ in range(dice.choice((5, 40, 400)))]
        bad = i % 5 == 0
        for _ in range(3 if bad else 0):
            words[dice.randrange(len(words))] = dice.choice(TOXIC) + dice.choice(["", "en", "ish", dice.choice(plain)])
        out.append((i, " ".join(words), int(bad)))
    return out


def test_features_are_those_of_each_text_alone():
    texts = ["Some words, and more.", None, "", "!?", "ß é ñ", "a", "some WORDS", "x" * 9000, "two  blanks"]
    together = feature_sets(texts)
    for text, found in zip(texts, together):
        doc, feature = features_of([text])
        assert set(doc) <= {0} and sorted(set(feature)) == list(found)
    assert set(feature_sets(["words some"])[0]) == set(together[6]) and not len(together[3])


def test_risk_stays_non_negative_and_weights_too():
    rows = corpus(400)
    toxic = feature_sets([t for _, t, bad in rows if bad][:40])
    rest = feature_sets([t for _, t, bad in rows if not bad] + [t for _, t, bad in rows if bad][40:])
    prior = 40 / 360
    features, weights, bias = fit(toxic, rest, prior)
    assert len(features) and (weights > 0).all()
    model = Model(np.array(features), np.array(weights), bias)
    held = corpus(300, seed=9)
    got = logits([t for _, t, _ in held], model) >= 0
    want = np.array([bad for *_, bad in held], bool)
    assert (got[want]).mean() > 0.9 and (got[~want]).mean() < 0.05


def test_scores_of_held_out_documents(spark):
    rows = corpus(600)
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, b) for i, _, b in rows if i % 3] + [(None, 1), (7, None), (3, 0), (3, 0)], "doc_id long, toxic int")
    train = docs.where(~held_out(F.col("doc_id")))
    model = learn(train, labels.where(~held_out(F.col("doc_id"))))
    again = learn(train.repartition(5), labels.where(~held_out(F.col("doc_id"))))
    assert np.allclose(model.weights, again.weights) and math.isclose(model.bias, again.bias)
    got = {r.doc_id: r for r in score(docs.where(held_out(F.col("doc_id"))), model).collect()}
    assert set(got) == {i for i, *_ in rows if zlib.crc32(str(i).encode()) % 5 == 0}
    for i, _, bad in rows:
        if i in got:
            assert got[i].predicted == int(got[i].score >= 0.5) and 0 <= got[i].score <= 1
    caught = [got[i].predicted for i, _, bad in rows if i in got and bad]
    wrong = [got[i].predicted for i, _, bad in rows if i in got and not bad]
    assert sum(caught) >= 0.9 * len(caught) and sum(wrong) <= 0.05 * len(wrong)


def test_harmless_text_does_not_hide_a_toxic_passage(spark):
    rows = corpus(400)
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    model = learn(docs, spark.createDataFrame([(i, b) for i, _, b in rows if i % 2 == 0], "doc_id long, toxic int"), members=2, toxic=30, unlabelled=150)
    filler = " ".join(t for _, t, b in rows if not b) * 3
    short = "vilewort gruntzeb moxfaul"
    alone, inside, clean = logits([short, filler + " " + short + " " + filler, filler], model)
    assert alone >= 0 and inside >= alone > clean


def test_toxicity_of_odd_rows(spark):
    kinds = "doc_id long, text string, score string, PREDICTED int, _score int"
    odd = spark.createDataFrame([(1, None, "a", 1, 1), (None, "", "b", 1, 1), (2, "fine words", "c", 1, 1), (2, "fine words", "c", 1, 1)], kinds)
    none = spark.createDataFrame([], "doc_id long, toxic int")
    out = score(odd, learn(odd, none))
    assert out.columns == ["doc_id", "text", "_score", "score", "predicted"]
    assert {(r.score, r.predicted) for r in out.collect()} == {(0.0, 0)} and out.count() == 4
    model = learn(odd, spark.createDataFrame([(2, 1), (2, 0)], "doc_id long, toxic int"))
    got = score(odd, model).collect()
    assert len(got) == 4 and all(0 <= r.score <= 1 for r in got) and len({r.score for r in got if r.doc_id == 2}) == 1
    assert score(odd.limit(0), model).count() == 0 and learn(odd.limit(0), none) is None
    assert learn(odd.where("text IS NULL"), spark.createDataFrame([(1, 1)], "doc_id long, toxic int")) is None


# --- op12 ---


def brute_trie(rows, modulus=20):
    turns = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            turns[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [x[2:] for x in sorted(t)] for c, t in turns.items()}
    built = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 4
        built[c] = own.get(c - int(math.fmod(c, modulus)), [])[:h] + own[c][h:]
    members = defaultdict(list)
    for c, t in built.items():
        for d in range(len(t) + 1):
            members[tuple(t[:d])].append(c)
    children = defaultdict(int)
    for p in members:
        if p:
            children[p[:-1]] += 1
    leaves, saved = defaultdict(int), defaultdict(int)
    for p, m in members.items():
        words = len(p[-1][1].translate(str.maketrans("\t\n\v\f\r", "     ")).replace("\xa0", "x").split(" ")) - p[-1][1].translate(str.maketrans("\t\n\v\f\r", "     ")).split(" ").count("") if p else 0
        for d in range(len(p) + 1):
            leaves[p[:d]] += not children[p]
            saved[p[:d]] += (len(m) - 1) * words
    return sorted((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), children[p], leaves[p], saved[p],
                   hashlib.sha256(",".join(str(c) for c in sorted(m) if len(built[c]) == len(p)).encode()).hexdigest()) for p, m in members.items()
                  ), built


COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
TURNS = "conv_id long, turn long, role string, text string"


def trie_of(spark, rows, kinds=TURNS):
    return sorted(tuple(r) for r in trie.prefix_trie(spark.createDataFrame(rows, kinds)).select(*COLUMNS).collect())


@pytest.fixture(scope="module")
def talks():
    dice = random.Random(11)
    rows = []
    for c in list(range(0, 130)) + [-3, -20, -41, 5000, 4096, 8191]:
        if c % 20 == 0 and c % 60:  # some bases do not exist
            continue
        for t in range(dice.choice((1, 2, 3, 4, 6))):
            rows.append((c, t, dice.choice(("user", "assistant")), dice.choice(("yes", "no", "a b c", "", " x  y\n"))))
    rows += [(300, 0, None, None), (300, None, "user", "first"), (301, 5, "b", "tie"), (301, 5, "a", "tie"), (301, 5, "a", "tie"), (None, 1, "user", "lost")]
    rows += [(c, t, "user", f"turn {t // 3}") for c in (310, 311, 312) for t in range(0, 400, 2)]  # several chunks
    rows += [(c, 10**12 * t, "user", "far") for c in (320, 321) for t in (-2, 0, 1, 3)]
    return rows


def test_trie_against_brute_force(spark, talks):
    want, built = brute_trie(talks)
    assert any(not t for t in built.values())
    assert trie_of(spark, talks) == want


def test_trie_of_very_many_copies(spark):
    rows = [(c, t, "user", f"same {t}") for c in range(9000, 18500) for t in range(3)]
    want, _ = brute_trie(rows)
    assert trie_of(spark, rows) == want


def test_trie_names_the_stored_turn(spark, talks):
    frame = spark.createDataFrame(talks, TURNS)
    _, built = brute_trie(talks)
    own = defaultdict(list)
    for c, turn, role, text in sorted((r for r in talks if r[0] is not None), key=lambda r: (r[0], r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")):
        own[c].append((role or "", text or ""))
    for r in trie.prefix_trie(frame).where("depth > 0").collect():
        assert own[r.turn_conv_id][r.turn_pos - 1] == built[r.conv_id][r.depth - 1]


def test_trie_is_made_anew_when_digests_meet(spark, talks, monkeypatch):
    asked = []
    monkeypatch.setattr(trie, "digests_agree", lambda turns, seed: asked.append(seed) or seed > 0)
    rows = talks[:60]
    assert trie_of(spark, rows) == brute_trie(rows)[0] and asked == [0, 2]


def test_digests_are_compared_with_texts(spark, monkeypatch):
    frame = spark.createDataFrame([(1, 1, "a", "x"), (2, 1, "a", "y"), (3, 1, "a", "x")], TURNS)
    assert trie.digests_agree(frame, 0)
    monkeypatch.setattr(trie.F, "xxhash64", lambda *a: F.lit(7))
    assert not trie.digests_agree(frame, 0) and trie.digests_agree(frame.where("text = 'x'"), 0)


def test_trie_of_odd_tables(spark):
    assert trie_of(spark, []) == [] and trie_of(spark, [(None, 1, "a", "b")]) == []
    long_text = "word " * 300_000
    rows = [(20, 1, "user", long_text, 1, "n"), (23, 1, "user", long_text, 2, "n"), (21, None, None, None, 3, "n")]
    assert trie_of(spark, rows, TURNS + ", depth int, turns string") == brute_trie([r[:4] for r in rows])[0]


# --- op13 ---


@pytest.mark.parametrize("bits,size", [(9, 64), (9, 0), (20, 2500), (28, 40)])
def test_residue_products_are_exact(bits, size):
    dice = np.random.default_rng(bits)
    a, b = (dice.integers(-2**bits, 2**bits, (7, size)) for _ in range(2))
    want = np.array([[sum(int(x) * int(y) for x, y in zip(u, v)) for v in b] for u in a], dtype=object)
    primes = primes_for(int(abs(want).max()) if size else 0)
    got = product(residues(a.astype(float), primes), residues(b.astype(float), primes), primes)
    assert got.dtype == np.int64 and (got == want).all()


def test_residues_at_the_edges():
    largest = 2**63 - 1
    primes = primes_for(largest)
    one = [[1.0], [-1.0]]
    for v in (2.0**62, -2.0**62, 0.0, 2.0**40 + 1):
        got = product(residues(np.array([[v]]), primes), residues(np.array(one), primes), primes)
        assert got.tolist() == [[int(v), -int(v)]]


def brute_negatives(rows, anchor, positives=5, negatives=3):
    one = {}
    for i, v, label in rows:
        if i is None or label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        q = [math.floor(256 * float(x)) for x in v]
        if any(abs(256 * float(x)) >= 2**32 for x in v) or sum(x * x for x in q) >= 2**63:
            continue
        if i not in one or (label, v) < one[i][2]:
            one[i] = (label, q, (label, v))
    out = []
    for a, (label, v, _) in one.items():
        if not anchor(a):
            continue
        scored = sorted((-sum(x * y for x, y in zip(v, w)), b, m) for b, (m, w, _) in one.items() if b != a and len(w) == len(v))
        for s, p, _ in [x for x in scored if x[2] == label][:positives]:
            inside = [x for x in scored if x[2] != label and 50 * -s <= 100 * -x[0] <= 95 * -s][:negatives]
            out += [(a, p, k + 1, n, -s, -t) for k, (t, n, _) in enumerate(inside)]
    return sorted(out)


@pytest.fixture(scope="module")
def vectors():
    dice = np.random.default_rng(2)
    centres = dice.normal(size=(4, 6))
    rows = []
    for i in range(400):
        v = (centres[i % 4] + dice.normal(size=6) * 0.5).astype(np.float32)
        v /= np.linalg.norm(v)
        rows.append((i, [float(np.float32(x)) for x in v], int(dice.integers(0, 3))))
    rows += [(1000 + i, rows[5][1], i % 3) for i in range(60)]  # ties
    rows += [(2000, None, 1), (2001, [1.0, None], 1), (2002, [float("nan")] * 6, 1), (2003, [float("inf")] * 6, 1), (2004, rows[0][1], None), (None, rows[0][1], 1)]
    rows += [(2010 + i, [0.5 + i / 50, 0.25], i % 2) for i in range(20)] + [(2050, [], 0), (2051, [], 0), (2052, [], 1), (2053, [0.0] * 6, 1)]
    rows += [(2060, [3e38] + [0.0] * 5, 1), (2061, [1e6] * 6, 1), (2062, [-1e6] * 6, 1), (2100, rows[7][1], 2), (2100, rows[9][1], 0), (2100, rows[9][1], 0)]
    return rows


@pytest.mark.parametrize("block_mb", [48, 0.002])
def test_negatives_against_brute_force(spark, vectors, block_mb):
    frame = spark.createDataFrame(vectors, "vec_id long, embedding array<float>, label int").repartition(3)
    got = mine(frame, F.col("vec_id") % 10 == 0, block_mb=block_mb)
    assert sorted(tuple(r) for r in got.collect()) == brute_negatives(vectors, lambda i: i % 10 == 0)


def test_negatives_of_odd_tables(spark, vectors):
    kinds = "vec_id long, embedding array<float>, label int, rank int, Norm string, score long"
    frame = spark.createDataFrame([(*r, 1, "x", 2) for r in vectors[:80]], kinds)
    assert sorted(tuple(r) for r in mine(frame, F.col("vec_id") % 20 == 0).collect()) == brute_negatives(vectors[:80], lambda i: i % 20 == 0)
    columns = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    for nothing in (mine(frame.limit(0), F.col("vec_id") % 20 == 0), mine(frame, F.col("vec_id") < 0), mine(frame.limit(1), F.col("vec_id") >= 0)):
        assert nothing.columns == columns and nothing.count() == 0
