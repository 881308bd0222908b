import zlib
from collections import Counter

import numpy as np
import pytest

from binlens.llm import sharding


@pytest.mark.parametrize("blocks,shards", [([5, 0, 7, 30], [21, 21]), ([1000] * 9, [375] * 24), ([0, 0], [0, 0, 0])])
def test_matrix_margins(blocks, shards):
    m = sharding.communication_matrix(blocks, shards, 1)
    assert m.sum(1).tolist() == blocks and m.sum(0).tolist() == shards and (m >= 0).all()


def test_matrix_follows_the_hypergeometric_law():
    """Block of 6 of 12 rows, shards of 4 and 8: P(k) = C(4,k) C(8,6-k) / C(12,6)."""
    from math import comb
    drawn = Counter(int(sharding.communication_matrix([6, 6], [4, 8], s)[0, 0]) for s in range(4000))
    for k in range(5):
        assert abs(drawn[k] / 4000 - comb(4, k) * comb(8, 6 - k) / comb(12, 6)) < 0.03


def test_beyond_the_exact_sampler():
    m = sharding.communication_matrix([3 * 10**9, 2 * 10**9], [10**9] * 5, 1)
    assert m.sum(1).tolist() == [3 * 10**9, 2 * 10**9] and m.sum(0).tolist() == [10**9] * 5


@pytest.mark.parametrize("block_rows", [5, 10_000])
def test_exact_sizes_gapless_slots_and_sizes(docs, corpus, block_rows):
    got = sharding.shard_rows(docs, shards=7, block_rows=block_rows, carry=False).collect()
    n = Counter(r.shard for r in got)
    assert len(got) == len(corpus) and set(n) == set(range(7)) and max(n.values()) - min(n.values()) <= 1
    for j in n:
        assert sorted(r.slot for r in got if r.shard == j) == list(range(n[j]))
    want = sorted(((i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t, *_ in corpus), key=str)
    assert sorted(((r.id, r["size"], r.text_crc32) for r in got), key=str) == want


def test_partitioning_does_not_matter(docs):
    a = sharding.shard_rows(docs, carry=False).collect()
    b = sharding.shard_rows(docs.repartition(1), carry=False).collect()
    assert sorted(map(str, a)) == sorted(map(str, b))


def test_shuffle_is_uniform(spark):
    """Each of 3000 ids lands in each of 4 shards, and on each side of a shard, about equally often."""
    got = sharding.shard_rows(spark.range(3000).selectExpr("id doc_id", "string(id) text"), shards=4, block_rows=100, carry=False).collect()
    low = np.array([[r.shard, r.slot < 375] for r in got if r.id < 1500])
    for j in range(4):
        assert abs((low[:, 0] == j).mean() - 0.25) < 0.05
    assert abs(low[:, 1].mean() - 0.5) < 0.05


def test_documents_empty_and_clashing(docs, clashing, empty_docs):
    out = sharding.shard_documents(docs)
    assert out.columns == [*docs.columns, "shard", "slot"] and out.count() == docs.count()
    assert sharding.shard_documents(clashing).columns == [*clashing.columns, "shard_1", "slot_1"]
    assert sharding.shard_documents(empty_docs).count() == 0
