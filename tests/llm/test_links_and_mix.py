"""op4, op5, op6, op7 and op10 on small frames, against brute force."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from fleetlens.llm import near_dedup
from fleetlens.llm.components import components
from fleetlens.llm.line_dedup import repeated_lines
from fleetlens.llm.mixing import mix, targets
from fleetlens.llm.near_dedup import near_duplicates, prefix_pairs
from fleetlens.llm.neighbours import nearest
from fleetlens.llm.shingles import MinMax, shingle_set
from fleetlens.llm import substring_dedup
from fleetlens.llm.substring_dedup import repeated_passages

DOCS = "doc_id long, text string"


def groups(nodes, links):
    of = {n: n for n in nodes}

    def root(x):
        while of[x] != x:
            x = of[x]
        return x

    for a, b in links:
        a, b = sorted((root(a), root(b)))
        of[b] = a
    return {n: root(n) for n in nodes}


def edited(dice, words, edits, vocabulary):
    words = list(words)
    for _ in range(edits):
        words[dice.randrange(len(words))] = dice.choice(vocabulary)
    return words


@pytest.fixture(scope="module")
def copies():
    """Families of near copies of all degrees, exact copies, odd texts."""
    dice = random.Random(7)
    vocabulary = [f"w{i}" for i in range(400)]
    rows = []
    for _ in range(12):
        base = [dice.choice(vocabulary) for _ in range(dice.choice((8, 30, 80)))]
        for k in range(7):
            rows.append(" ".join(edited(dice, base, dice.randrange(0, max(2, len(base) // 12)), vocabulary)))
    rows += [rows[0].upper(), None, "", " \n", "one two", "ONE  two", "a b c d e", "a b c d e f"]
    dice.shuffle(rows)
    return list(enumerate(rows))


def test_components(spark):
    dice = random.Random(3)
    links = [(dice.randrange(120), dice.randrange(120)) for _ in range(90)] + [(200 + i, 201 + i) for i in range(40)] + [(300, 301 + i) for i in range(30)] + [(5, 5), (7, None)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    real = [(a, b) for a, b in links if b is not None]
    assert got == groups({x for p in real for x in p}, real)
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_min_max_is_unbiased():
    minmax, dice = MinMax(200, 1), np.random.RandomState(5)
    seen = []
    for _ in range(20):
        x = dice.randint(0, 2**63, 300).astype(np.uint64)
        a, b = np.unique(x[:240]), np.unique(x[60:])  # similarity 0.6
        k = minmax.keys(np.concatenate([a, b]), np.array([0, len(a)]))
        seen.append((k[0] == k[1]).mean())
    assert abs(np.mean(seen) - 0.6) < 0.02


def linked(copies):
    sets = {i: set(shingle_set(t).tolist()) for i, t in copies}
    return sets, [(a, b) for a, b in itertools.combinations(sets, 2) if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]


def test_near_duplicates(spark, copies):
    sets, links = linked(copies)
    want = groups(sets, links)
    frame = spark.createDataFrame(copies, DOCS).withColumn("component_id", F.lit(1)).withColumn("id", F.lit("x"))
    got = {r["doc_id"]: r for r in near_duplicates(frame).collect()}
    assert {i: r["component_id"] for i, r in got.items()} == want
    assert all(r["n_shingles"] == len(sets[i]) and r["kept"] == (want[i] == i) for i, r in got.items())
    assert len(set(want.values())) < len(want) - 40
    odd = near_duplicates(spark.createDataFrame([(1, "a b"), (1, "a b"), (None, "a b"), (2, "A b")], DOCS)).collect()
    assert sorted((str(r["doc_id"]), r["component_id"], r["kept"]) for r in odd if r["doc_id"]) == [("1", 1, True), ("1", 1, True), ("2", 1, False)]
    assert near_duplicates(spark.createDataFrame([], DOCS)).collect() == []


def test_prefix_join_finds_every_link_across(spark, copies):
    """The exact part alone, with components of one set each."""
    sets, links = linked(copies)
    rows = [(i, len(s), list(np.array(sorted(s), np.uint64).view(np.int64).tolist()), i) for i, s in sets.items() if s]
    pairs = {(r["a"], r["b"]) for r in prefix_pairs(spark.createDataFrame(rows, "id long, n long, shingles array<long>, component long"), 75).collect()}
    assert {tuple(sorted(x)) for x in links if sets[x[0]] != sets[x[1]]} <= pairs
    assert len(pairs) < len(rows) * 20


def test_missed_buckets_are_made_good(spark, copies, monkeypatch):
    """With few bands the first rounds miss links that the residual join has to find wherever a bucket is shared."""
    sets, links = linked(copies)
    got = {r["doc_id"]: r["component_id"] for r in near_duplicates(spark.createDataFrame(copies, DOCS), bands=24, rows=2).collect()}
    assert got == groups(sets, links)
    assert near_dedup.BANDS * near_dedup.ROWS == 240


def test_near_duplicates_of_an_id_with_two_texts(spark):
    one, two = "one two three four five six", "seven eight nine ten eleven twelve"
    rows = [(5, one), (5, two), (2, one), (3, two), (7, "something else that stands on its own")]
    got = sorted((r["doc_id"], r["component_id"], r["kept"]) for r in near_duplicates(spark.createDataFrame(rows, DOCS)).collect())
    assert got == [(2, 2, True), (3, 2, False), (5, 2, False), (5, 2, False), (7, 7, True)]


def test_neighbours(spark):
    dice = np.random.RandomState(11)
    x = dice.randn(700, 16).astype(np.float32)
    x[50:80] = x[50]  # copies
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    odd = [(1000, None), (1001, [0.0] * 16), (1002, [float("nan")] * 16), (1003, [float("inf")] + [0.0] * 15), (1004, [None] * 16), (1005, [1.0, 2.0]), (1006, [])]
    frame = spark.createDataFrame(rows + odd + rows[:3], "vec_id long, embedding array<float>")
    got = nearest(frame, F.col("vec_id") % 25 == 0, degree=12, iterations=3, beam=32, rounds=5).collect()
    hits = total = 0
    for q in range(0, 700, 25):
        d = np.sqrt(((x.astype(np.float64) - x[q].astype(np.float64)) ** 2).sum(1))
        want = [i for i in np.lexsort((np.arange(700), d)) if i != q][:10]
        mine = sorted((r["rank"], r["vec_id"], r["score"]) for r in got if r["query_id"] == q)
        assert [r for r, _, _ in mine] == list(range(1, 11))
        assert all(abs(s - d[i]) < 1e-12 for _, i, s in mine)
        hits, total = hits + len({i for _, i, _ in mine} & set(want)), total + 10
        if q in (50, 75):
            assert [i for _, i, _ in mine] == [i for i in range(50, 80) if i != q][:10]
    assert hits / total >= 0.95 and {r["query_id"] for r in got} == set(range(0, 700, 25))
    few = nearest(spark.createDataFrame(rows[:4], "vec_id long, embedding array<float>"), F.col("vec_id") == 0).collect()
    assert len(few) == 3
    assert nearest(frame.limit(0), F.col("vec_id") == 0).collect() == []


@pytest.mark.parametrize("skew", ["near copies", "long vectors"])
def test_neighbours_of_skewed_vectors(spark, skew):
    dice = np.random.RandomState(13)
    x = dice.randn(900, 16)
    if skew == "near copies":
        x[:600] = np.repeat(x[:6], 100, axis=0) + 1e-5 * dice.randn(600, 16)
    else:
        x[::300] *= 1e6
    x = x.astype(np.float32)
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    got = nearest(frame, F.col("vec_id") % 20 == 1, degree=12, iterations=3, beam=32, rounds=5).collect()
    hits = 0
    for q in range(1, 900, 20):
        d = ((x.astype(np.float64) - x[q].astype(np.float64)) ** 2).sum(1)
        hits += len({r["vec_id"] for r in got if r["query_id"] == q} & set([i for i in np.lexsort((np.arange(900), d)) if i != q][:10]))
    assert hits >= 0.95 * 450


def test_targets(spark):
    sizes = [("a", 100), ("b", 1000), (None, 50), ("c", 10), ("d", 0)]
    got = {r["source"]: r["target"] for r in targets(spark.createDataFrame(sizes, "source string, source_size long"), (5, 2, 1), 3).collect()}
    order = sorted((s for s, _ in sizes if s), key=lambda s: s) + [None]
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    size, left, want = dict(sizes), sum(n for _, n in sizes), {}
    free = set(order)
    while True:  # share, bound, share again
        level = left / sum(weight[s] for s in free)
        over = {s for s in free if weight[s] * level > 3 * size[s]}
        if not over:
            break
        for s in over:
            want[s] = 3 * size[s]
            left -= want[s]
        free -= over
    want |= {s: weight[s] * level for s in free}
    assert got == pytest.approx(want) and sum(got.values()) == pytest.approx(1160)


def test_mix(spark):
    dice = random.Random(5)
    rows = [(i, dice.choice(("s0", "s1", "s2", None)), "w " * dice.choice((0, 1, 3, 20, 20, 50, 700))) for i in range(600)] + [(900, "s9", None), (901, "s9", " two  words \n")]
    frame = spark.createDataFrame(rows, "doc_id long, source string, text string").withColumn("size", F.lit("x")).withColumn("class", F.lit(1))
    runs = [sorted((r["doc_id"], r["size"], r["source_size"], r["target"], r["taken"]) for r in mix(f, (5, 2, 1)).collect()) for f in (frame, frame.repartition(5))]
    assert runs[0] == runs[1] and len(runs[0]) == len(rows)
    source = {i: s for i, s, _ in rows}
    words = {i: len((t or "").split()) for i, _, t in rows}
    for s in ("s0", "s1", "s2", None):
        part = [r for r in runs[0] if source[r[0]] == s]
        assert all(r[1] == words[r[0]] and r[2] == sum(words[x[0]] for x in part) and r[4] <= 3 * r[1] for r in part)
        assert abs(sum(r[4] for r in part) - part[0][3]) <= 0.01 * part[0][3] + 3
    assert mix(spark.createDataFrame([], "doc_id long, source string, text string"), (5, 2, 1)).collect() == []


def within_one(a, b):
    if abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) <= 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def test_lines(spark):
    dice = random.Random(9)
    base = ["".join(dice.choice("abcde é") for _ in range(n)) + "." for n in (5, 19, 20, 21, 40, 41, 90, 700)]
    rows = []
    for i in range(60):
        lines = []
        for _ in range(dice.randrange(1, 4)):
            s = dice.choice(base)
            for _ in range(dice.choice((0, 0, 1, 1, 2))):
                p = dice.randrange(len(s))
                s = dice.choice((s[:p] + s[p + 1:], s[:p] + dice.choice("xyé") + s[p:], s[:p] + "z" + s[p + 1:]))
            lines.append(s)
        rows.append((i, "\n".join(lines + [""] * (i % 2))))
    rows += [(100, None), (101, ""), (102, " \t\n")]
    places = [(i, k, s) for i, t in rows if t is not None for k, s in enumerate(t.split("\n")) if s.strip(" \t\n\x0b\x0c\r")]
    first = {}
    for i, k, s in sorted(places):
        first.setdefault(s, (i, k))
    want = set()
    for i, k, s in places:
        e = min([first[s]] + [first[o] for o in first if len(s) >= 20 and len(o) >= 20 and within_one(s, o)])
        want.add((i, k, *e))
    short = {s for _, _, s in places if len(s) == 20}
    got = {(r["doc_id"], r["line_no"], r["earlier_id"], r["earlier_line"]) for r in repeated_lines(spark.createDataFrame(rows, DOCS)).collect()}
    assert short and got == want
    assert repeated_lines(spark.createDataFrame([], DOCS)).collect() == []


def test_passages(spark):
    dice = random.Random(21)
    text = lambda n: [f"t{dice.randrange(5000)}" for _ in range(n)]
    passage, other = text(51), text(60)
    rows = [text(300) for _ in range(20)]
    for i in (3, 8, 15):
        p = dice.randrange(250)
        rows[i] = rows[i][:p] + passage + rows[i][p:]
    rows[5] = rows[5][:10] + other
    rows[6] = other + rows[6]
    rows[7] = other[:20] + rows[7]  # too little of it
    docs = [(i, " ".join(w).replace(" ", "\n", 3)) for i, w in enumerate(rows)] + [(90, None), (91, ""), (92, "few words")]
    got = repeated_passages(spark.createDataFrame(docs, DOCS).withColumn("words", F.lit(1))).collect()
    assert {r["doc_id"] for r in got} == {3, 5, 6, 8, 15}
    for r in got:
        # a paragraph may lie a few words beside its like in another document
        w = rows[r["doc_id"]][r["start"]:r["start"] + r["words"]]
        assert len(w) == 27 and sum(x in passage or x in other for x in w) >= 20
        assert r["kept"] == ((r["doc_id"], r["start"]) == (r["component_id"], r["component_start"]))
    assert repeated_passages(spark.createDataFrame([], DOCS)).collect() == []


def test_near_paragraphs(spark):
    dice = random.Random(5)
    text = lambda n: [f"t{dice.randrange(5000)}" for _ in range(n)]
    lines, docs = {}, []
    for i in range(80):
        original = text(dice.randrange(36, 54))
        for j in (2 * i, 2 * i + 1):
            # a changed word in the middle leaves no 27 words in a row as they were
            body = [f"new{j}" if j % 2 and k == len(original) // 2 else w for k, w in enumerate(original)]
            before, after = text(40), text(40)
            lines[j, 40] = body
            docs.append((j, "\n".join(" ".join(x) for x in (before, body, after))))
    sets = {k: shingle_set(" ".join(x)) for k, x in lines.items()}
    links = [(a, b) for a, b in itertools.combinations(sorted(sets), 2) if 100 * len(np.intersect1d(sets[a], sets[b])) >= 75 * len(np.union1d(sets[a], sets[b]))]
    want = groups(sets, links)
    got = {(r["doc_id"], r["start"]): (r["component_id"], r["component_start"]) for r in repeated_passages(spark.createDataFrame(docs, DOCS)).collect() if r["words"] == len(lines.get((r["doc_id"], r["start"]), ()))}
    planted = {x for link in links for x in link}
    assert len(links) > 25 and set(got) <= planted
    assert sum(got.get(x) == want[x] for x in planted) >= 0.99 * len(planted)


def test_whole_passages(spark):
    dice = random.Random(8)
    text = lambda n: [f"t{dice.randrange(50000)}" for _ in range(n)]
    rows = [text(dice.randrange(60, 200)) for _ in range(60)]
    want = {}
    for i in range(0, 60, 3):
        passage = text((51, 60, 80, 140)[i // 3 % 4])
        # the first has the middle alone, so the third has to find its edges in the second
        for j, part in ((i, passage[8:-8]), (i + 1, passage), (i + 2, passage)):
            p = dice.choice([0, 30, len(rows[j])])
            rows[j] = rows[j][:p] + part + rows[j][p:]
            want[j] = (p, len(part))
    docs = [(i, " ".join(w)) for i, w in enumerate(rows)]
    covered = {}
    for r in repeated_passages(spark.createDataFrame(docs, DOCS)).collect():
        assert r["passage_start"] <= r["start"] and r["start"] + r["words"] <= r["passage_start"] + r["passage_words"]
        if not r["kept"]:
            covered.setdefault(r["doc_id"], set()).add((r["passage_start"], r["passage_words"]))
    # the third document repeats all of the second; a run that is a near copy may lie up to three words over the edge
    for j in range(2, 60, 3):
        ((start, words),) = covered[j]
        p, n = want[j]
        assert p - 3 <= start <= p and p + n <= start + words <= p + n + 3
    assert sum(covered[j] == {want[j]} for j in range(2, 60, 3)) >= 14


def test_pipeline(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    odd = spark.createDataFrame([(-1, None, "en", "src0", 0), (-2, "12 34", "en", "src0", 5)], docs.schema)
    taken = {}
    frame = docs.unionAll(odd).withColumn("extra", F.lit(1))
    for name, stage in corpus_pipeline.STAGES:
        before = {r["doc_id"] for r in frame.select("doc_id").collect()}
        out = stage(spark, frame, None)
        taken[name] = out.collect()
        assert {r["doc_id"] for r in taken[name]} <= before
        frame = spark.createDataFrame(taken[name], out.schema)
    assert {r["doc_id"] for r in taken["language_id"]} == {r["doc_id"] for r in docs.collect()}
    left = [x for r in taken["line_dedup"] for x in r["text"].split("\n") if x.strip()]
    assert len(left) == len(set(left))
    kept = [(r["doc_id"], set(shingle_set(r["text"]).tolist())) for r in taken["near_dedup"]]
    assert not any(a[1] and b[1] and 100 * len(a[1] & b[1]) >= 75 * len(a[1] | b[1]) for a, b in itertools.combinations(kept, 2))
    assert len(taken["sentencepiece"]) == len(taken["mix_sources"]) > 50
    empty = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        out = stage(spark, empty, None)
        assert out.collect() == []
        empty = spark.createDataFrame([], out.schema)


def test_copies_of_passages_are_settled_as_a_whole(spark, monkeypatch):
    """Prefixes are taken apart where words differ, not for each copy."""
    dice = random.Random(3)
    text = lambda n: [f"t{dice.randrange(50000)}" for _ in range(n)]
    sizes, write = {}, substring_dedup.settled

    def noted(df, label):
        out = write(df, label)
        sizes[label] = out.count()
        return out

    monkeypatch.setattr(substring_dedup, "settled", noted)
    body, tail = text(200), text(10)
    docs = [(i, " ".join(body)) for i in range(40)]
    repeated_passages(spark.createDataFrame(docs, DOCS)).collect()
    assert sizes["passage-beside"] > 40 and sizes["passage-kinds"] == 0
    # behind the last run the documents agree for a few words yet
    docs = [(i, " ".join(body + tail + text(120))) for i in range(3)]
    got = repeated_passages(spark.createDataFrame(docs, DOCS)).collect()
    assert {(r["passage_start"], r["passage_words"]) for r in got if not r["kept"]} == {(0, 210)}
    assert sizes["passage-kinds"] > 0


def test_first_smallest_of_rows_with_equal_windows():
    dice = np.random.RandomState(1)
    for few in (3, 40, 2**40):
        for n in (25, 26, 49, 300):
            w = dice.randint(0, few, n).astype(np.uint64)
            rows = np.lib.stride_tricks.sliding_window_view(w, 25)
            assert (substring_dedup._smallest_in_rows(w) == np.unique(np.argmin(rows, axis=1) + np.arange(len(rows)))).all()


def test_a_star_around_its_smallest_node_ends_in_one_round(spark, monkeypatch):
    from fleetlens.llm import components as module

    labels, settle = [], module.settled
    monkeypatch.setattr(module, "settled", lambda df, label: (labels.append(label), settle(df, label))[1])
    got = module.components(spark.range(1, 65).selectExpr("0L AS a", "id AS b")).collect()
    assert {(r["node"], r["component"]) for r in got} == {(i, 0) for i in range(65)}
    assert labels.count("component-hooks") == 1
