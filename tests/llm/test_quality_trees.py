import pickle
import zlib

import numpy as np

from creaseline.llm import quality_trees as q
from creaseline.llm.queries import QUERIES


def test_trees_learn_and_flat_walk_equals_a_plain_one():
    draw = np.random.default_rng(1)
    x = draw.normal(size=(4000, 6)).astype(np.float32)
    y = ((x[:, 0] > 0.3) ^ (x[:, 3] < -0.2)).astype(float)
    model = q.fit(x[:3000], y[:3000], trees=60, depth=3)
    assert ((model.score(x[3000:]) > 0.5) == y[3000:]).mean() > 0.97
    for row in x[3000:3050]:
        total = model.base
        for t in range(60):
            node = 0
            while node < 7:
                node = 2 * node + (2 if row[model.feature[t, node]] > model.threshold[t, node] else 1)
            total += model.leaf[t, node - 7]
        assert abs(model.score(row[None])[0] - 1 / (1 + np.exp(-total))) < 1e-9


def test_without_labels_every_score_is_the_share():
    x = np.zeros((3, q.FEATURES), np.float32)
    assert q.fit(x[:0], np.zeros(0)).score(x).tolist() == [0.5] * 3
    assert np.allclose(q.fit(x, np.ones(3)).score(x), 0.8)


def test_statistics_are_finite():
    rows = q.statistics(["", " ", "\n\n", "a", "é" * 1000, "x" * 300_000, "a b. C! 7 |", "\0"])
    assert rows.shape == (8, q.FEATURES) and np.isfinite(rows).all()


def test_edge_cases(spark, documents, keep):
    rows = [(i, ("good text here. " * 9 if i % 2 else "bad ||| ### ") * 3) for i in range(200)] + [(500, None), (501, ""), (None, "x"), (7, "again"), (7, "again")]
    marks = [(i, i % 2, None) for i in range(200)] + [(3, None, 1), (None, 1, 1), (9999, 1, 0), (5, 1, 0)]
    labels = spark.createDataFrame(marks, "doc_id long, quality long, toxic long").selectExpr("*", "'x' as text", "1 as x")
    got = q.quality_scores(documents(rows), labels, keep).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    right = [(r.score >= 0.5) == bool(r.doc_id % 2) for r in got if r.doc_id is not None and r.doc_id < 200 and r.doc_id != 7]
    assert np.mean(right) > 0.95
    assert q.quality_scores(documents([]), labels, keep).count() == 0
    assert {r.score for r in q.quality_scores(documents(rows), labels.limit(0), keep).collect()} == {0.5}


def test_bounded_sample(documents, spark, keep):
    rows = [(i, "good text here. " * 9 if i % 2 else "bad ||| ### ") for i in range(600)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(600)], "doc_id long, quality int")
    got = q.quality_scores(documents(rows), labels, keep, fit_rows=200).collect()
    assert np.mean([(r.score >= 0.5) == bool(r.doc_id % 2) for r in got]) > 0.95


def test_held_out_accuracy(spark):
    data = "/root/testdata/sf0.01"
    rows = QUERIES["op6_quality_trees"](spark, data).collect()
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{data}/labels.parquet").collect()}
    assert len(rows) == spark.read.parquet(f"{data}/documents.parquet").count()
    own = [(r.score, r.predicted, labels[r.doc_id]) for r in rows if r.held_out and r.doc_id in labels]
    assert len(own) > 40 and np.mean([p == y for _, p, y in own]) > 0.95
    good, bad = [s for s, _, y in own if y], [s for s, _, y in own if not y]
    assert np.mean([a > b for a in good for b in bad]) > 0.97
    assert all(r.predicted == int(r.score >= 0.3) for r in rows)


def test_the_sent_model_needs_no_package(spark, documents, keep, monkeypatch):
    sent = []
    context = spark.sparkContext
    broadcast = context.broadcast
    monkeypatch.setattr(context, "broadcast", lambda value: sent.append(pickle.dumps(value)) or broadcast(value))
    labels = spark.createDataFrame([(i, i % 2) for i in range(20)], "doc_id long, quality long")
    assert q.quality_scores(documents([(i, f"text {i}") for i in range(20)]), labels, keep).count() == 20
    assert len(sent) == 1 and b"creaseline" not in sent[0]
