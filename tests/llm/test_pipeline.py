import corpus_pipeline as c
from tempograph.llm import bpe, quality
from test_decontamination import brute as holds
from test_exact_dedup import brute as copies
from test_near_dedup import brute as near
from test_packing import check


def test_against_brute_force(spark):
    path = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{path}/documents.parquet")
    texts = {x.doc_id: x.text for x in docs.collect()}
    predicted = {x.doc_id: x.predicted for x in quality.scored(docs, spark.read.parquet(f"{path}/labels.parquet")).collect()}
    left = {i: t for i, t in texts.items() if predicted[i] == 1}
    left = {i: left[i] for i, v in copies(left.items()).items() if v[2]}
    left = {i: left[i] for i, v in near(left.items(), 5).items() if v[2]}
    bench = [(x.item_id, x.text) for x in spark.read.parquet(f"{path}/benchmark.parquet").collect()]
    held = holds(left.items(), bench)
    left = {i: t for i, t in left.items() if not held[i]}
    assert 0 < len(left) < len(texts)
    rows = c.run(spark, path).collect()
    assert check(rows, left) < 0.05 * sum(r.length for r in rows)


def test_stages_keep_the_columns(spark):
    path = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{path}/documents.parquet")
    for _, stage in c.STAGES[:-1]:
        assert stage(spark, docs, path).columns == docs.columns
    assert len(c.STAGES) == 5 and bpe.default_path()


def test_empty(spark):
    path = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{path}/documents.parquet").limit(0)
    for _, stage in c.STAGES:
        assert stage(spark, docs, path).collect() == []
