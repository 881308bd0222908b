"""The pipeline's stages on a small folder, against the operators' plain versions."""

import tempfile

import pytest

import corpus_pipeline as P


def by_stage(spark, folder):
    docs, out = spark.read.parquet(f"{folder}/documents.parquet"), {}
    for name, stage in P.STAGES:
        path = tempfile.mkdtemp(prefix="run-stage-") + "/out"
        stage(spark, docs, folder).write.parquet(path)
        docs = spark.read.parquet(path)
        out[name] = docs.collect()
    return out


@pytest.fixture(scope="module")
def folder(spark, docs, corpus):
    path = tempfile.mkdtemp(prefix="run-pipe-")
    docs.write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(1, " ".join(corpus[20][1].split()[5:40]))], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


def test_stages(spark, folder, corpus, docs):
    kept = by_stage(spark, folder)
    quality, near, clean, mixed, sharded = (kept[n] for n, _ in P.STAGES)
    failing = {r[0] for r in corpus if len((r[1] or "").split()) < 50}
    ids = {r.doc_id for r in quality}
    assert not ids & failing - {None} and {r[0] for r in corpus[:60]} <= ids
    # one of each group: 5's copies, 7's near copies that are close enough, and the repeated row 9
    assert len({r.doc_id for r in near}) == len(near) and 5 in {r.doc_id for r in near} and not {r.doc_id for r in near} & set(range(60, 70))
    assert {r.doc_id for r in near} - {r.doc_id for r in clean} == {20}
    assert {r.doc_id for r in mixed} <= {r.doc_id for r in clean}
    assert sorted(str((r.doc_id, r.text)) for r in mixed) == sorted(str((r.doc_id, r.text)) for r in sharded)
    n = [sum(r.shard == j for r in sharded) for j in range(24)]
    assert max(n) - min(n) <= 1


def test_columns_and_rerun(spark, folder, docs):
    for name, rows in by_stage(spark, folder).items():
        want = [*docs.columns, "shard", "slot"] if name == "shard" else docs.columns
        assert not rows or rows[0].__fields__ == want
    a, b = (sorted(map(str, P.run(spark, folder).collect())) for _ in range(2))
    assert a == b


def test_empty_tables(spark, empty_docs, benchmark_schema="item_id long, text string"):
    path = tempfile.mkdtemp(prefix="run-pipe-")
    empty_docs.write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([], benchmark_schema).write.parquet(f"{path}/benchmark.parquet")
    assert P.run(spark, path).count() == 0
