"""Streaming ingestion: the stream's table equals the batch extraction; a second trigger only
adds new files; duplicates are dropped across triggers."""

import os
import tempfile

import pytest

from binlens.operators.pe import raw_feature_table
from binlens.sources.binary import scan_binaries
from binlens.streaming.ingest import ingest_stream

from test_pe_decode import make_pe


def _write(root, rel, data):
    p = os.path.join(root, rel)
    os.makedirs(os.path.dirname(p), exist_ok=True)
    with open(p, "wb") as fh:
        fh.write(data)


def test_stream_matches_batch_and_is_incremental(spark):
    work = tempfile.mkdtemp(prefix="binlens-stream-")
    root, out, rej, ck = (os.path.join(work, d) for d in ("corpus", "table", "rejects", "ckpt"))
    a = make_pe(1595927012, [(b".text", 100), (b".data", 200)])
    b = make_pe(1262304000, [(b".text", 50)], machine=0x8664, pe32_plus=True)
    _write(root, "benign/a.exe", a)
    _write(root, "malware/b.exe", b)
    _write(root, "malware/junk.exe", b"not a pe file")
    ingest_stream(spark, root, out, rej, checkpoint=ck).awaitTermination(120)
    got = spark.read.parquet(out)
    assert got.count() == 2
    assert spark.read.parquet(rej).count() == 1
    batch, _ = raw_feature_table(scan_binaries(spark, root))
    cols = sorted(batch.columns)
    assert sorted(map(tuple, got.select(cols).collect())) == sorted(map(tuple, batch.select(cols).collect()))

    # second trigger: one new file and one exact copy of an old one (different name)
    _write(root, "benign/c.exe", make_pe(1400000000, [(b".rsrc", 10)]))
    _write(root, "malware/a_copy.exe", a)
    ingest_stream(spark, root, out, rej, checkpoint=ck).awaitTermination(120)
    got = spark.read.parquet(out)
    assert got.count() == 3
    assert got.select("batch_id").distinct().count() == 2


def test_replayed_batch_changes_nothing(spark):
    from binlens.sources.binary import scan_binaries as scan
    from binlens.streaming.ingest import _process
    work = tempfile.mkdtemp(prefix="binlens-replay-")
    root, out, rej = (os.path.join(work, d) for d in ("corpus", "table", "rejects"))
    _write(root, "benign/a.exe", make_pe(1595927012, [(b".text", 100)]))
    _write(root, "malware/junk.exe", b"not a pe file")
    run = _process(out, rej, None)
    run(scan(spark, root), 0)
    for _ in range(2):      # batch 1 is delivered twice
        run(scan(spark, root), 1)
    assert spark.read.parquet(out).count() == 1
    assert spark.read.parquet(rej).groupBy("batch_id", "sample_id").count().where("count > 1").count() == 0


def test_unreadable_table_is_an_error(spark):
    from binlens.streaming.ingest import _table
    work = tempfile.mkdtemp(prefix="binlens-broken-")
    assert _table(spark, work + "/none") is None
    _write(work, "t/part-0.parquet", b"not parquet")
    with pytest.raises(Exception):
        _table(spark, work + "/t").count()
