"""op5 over several parts: what travels, and what is found, against brute force."""

import numpy as np
from pyspark.sql import functions as F

from fleetlens.llm import neighbours


def test_a_part_gets_a_vector_once(spark, monkeypatch):
    x = np.random.RandomState(17).randn(1500, 12).astype(np.float32)
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    rounds = []

    def settled(df, label, own=neighbours.settled):
        out = own(df, label)
        if label == "graph-members":
            rows = out.collect()
            asked = [(r["src"], r["part"], i) for r in rows if r["kind"] == neighbours.WANTED for i in np.frombuffer(r["a"], "i4").tolist()]
            seats = sum(len(r["b"]) // 8 for r in rows if r["kind"] == neighbours.MEMBERS)
            rounds.append((asked, seats))
        return out

    monkeypatch.setattr(neighbours, "SEATS", 1)
    monkeypatch.setattr(neighbours, "settled", settled)
    got = neighbours.nearest(frame, F.col("vec_id") % 30 == 0, degree=12, beam=48, changed=0.0, iterations=2).collect()
    assert len(rounds) == 2
    for asked, seats in rounds:
        assert len({home for _, home, _ in asked}) == 6  # all parts
        assert len(asked) == len(set(asked)) <= 6 * 1500 < seats
    hits = 0
    for q in range(0, 1500, 30):
        d = np.sqrt(((x.astype(np.float64) - x[q].astype(np.float64)) ** 2).sum(1))
        mine = sorted((r["rank"], r["vec_id"], r["score"]) for r in got if r["query_id"] == q)
        assert [r for r, _, _ in mine] == list(range(1, 11)) and all(abs(s - d[i]) < 1e-12 for _, i, s in mine)
        hits += len({i for _, i, _ in mine} & set(sorted((i for i in range(1500) if i != q), key=lambda i: d[i])[:10]))
    assert hits >= 0.95 * 500
