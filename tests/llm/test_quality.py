import random
import zlib

import numpy as np

from tempograph.llm import quality as q


def auc(score, label):
    order = np.argsort(score)
    ranks = np.empty(len(score))
    ranks[order] = np.arange(1, len(score) + 1)
    n1 = label.sum()
    return (ranks[label == 1].sum() - n1 * (n1 + 1) / 2) / (n1 * (len(label) - n1))


def test_trees_learn_and_flatten():
    r = np.random.default_rng(0)
    x = r.normal(size=(2000, 5))
    y = ((x[:, 0] * x[:, 1] > 0) & (x[:, 2] > -1)).astype(float)
    t = q.fit(x[:1000], y[:1000])
    assert auc(t.scores(x[1000:]), y[1000:]) > 0.95

    def walk(row):
        total = t.prior
        for node in t.roots:
            while t.left[node] != node:
                node = t.left[node] if row[t.feature[node]] <= t.cut[node] else t.right[node]
            total += t.value[node]
        return 1 / (1 + np.exp(-total))

    assert np.allclose([walk(r) for r in x[:50]], t.scores(x[:50]))
    assert np.allclose(q.fit(x, np.ones(2000)).scores(x), 2001 / 2002)


def test_held_out_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    rows = q.scored(docs, labels).collect()
    assert len(rows) == docs.count()
    quality = {x.doc_id: x.quality for x in labels.collect()}
    assert all(x.held_out == (zlib.crc32(str(x.doc_id).encode()) % 5 == 0) and x.predicted == (x.score >= 0.3) for x in rows)
    held = [x for x in rows if x.held_out and x.doc_id in quality]
    assert auc(np.array([x.score for x in held]), np.array([quality[x.doc_id] for x in held])) > 0.9
    kept = q.accepted(docs, labels)
    assert kept.columns == docs.columns and kept.count() == sum(x.predicted for x in rows)


def test_cases(spark):
    r = random.Random(0)
    rows = [(i, " ".join(r.choice(["of", "the", "wood"]) for _ in range(50)) if i % 2 else "!!" * 30, 1) for i in range(200)] + [(300, None, 1), (301, "", 1), (None, "x", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score int")
    labels = spark.createDataFrame([(i, i % 2) for i in range(200)] + [(5, None), (None, 1), (7, 1)], "doc_id long, quality int")
    got = q.scored(docs, labels).collect()
    assert len(got) == len(rows) and all(0 <= x.score <= 1 for x in got)
    assert all(x.predicted == x.doc_id % 2 for x in got if x.doc_id is not None and x.doc_id < 200)
    assert len({x.score for x in q.scored(docs, labels.limit(0)).collect()}) == 1
    assert q.scored(docs.limit(0), labels).collect() == []
