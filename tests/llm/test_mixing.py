import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from binlens.llm import mixing

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_targets(sizes):
    names = sorted((s for s in sizes if s is not None)) + [s for s in sizes if s is None]
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    target, free, rest = {}, set(names), float(sum(sizes.values()))
    while free:
        share = {s: rest * weight[s] / sum(weight[x] for x in free) for s in free}
        over = [s for s in free if share[s] > 3 * sizes[s]]
        if not over:
            return target | share
        for s in over:
            target[s] = 3.0 * sizes[s]
            rest -= target[s]
            free.discard(s)
    return target


def test_targets_stop_at_three_times(spark):
    sizes = {"a": 10, "b": 1000, "c": 3, "d": 50, "e": 0, None: 400}
    got = {r.source: r.target for r in mixing.source_targets(spark.createDataFrame(list(sizes.items()), "source string, size long")).collect()}
    assert got == pytest.approx(plain_targets(sizes))
    assert sum(got.values()) == pytest.approx(sum(sizes.values()))


@pytest.mark.parametrize("n", [1, 2, 7, 64, 1000])
def test_permutation(spark, n):
    df = spark.range(n).select("id", F.lit(3).alias("rank"), F.lit(1).cast("long").alias("epoch"))
    got = [r.p for r in df.select(mixing._permuted(F.col("id"), mixing._keys(), F.lit(n).cast("long")).alias("p")).collect()]
    assert sorted(got) == list(range(n))
    assert n < 50 or got != sorted(got)


def test_taken_words(docs, corpus):
    got = mixing.mix_counts(docs).collect()
    assert sorted(((r.id, r["size"], r.source) for r in got), key=str) == sorted(
        ((i, len(WORD.findall(t or "")), s) for i, t, _, s, _ in corpus), key=str)
    sizes, target, taken = defaultdict(int), {}, Counter()
    for r in got:
        sizes[r.source] += r["size"]
        target[r.source] = r.target
        taken[r.source] += r.taken
        assert 0 <= r.taken <= 3 * r["size"]
    assert all(r.source_size == sizes[r.source] for r in got)
    assert target == pytest.approx(plain_targets(sizes))
    for s in sizes:
        assert abs(taken[s] - target[s]) <= max(3 * mixing.BLOCK, 0.02 * target[s])
    again = mixing.mix_counts(docs.repartition(1)).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))


def test_documents_hold_the_taken_words(docs, corpus, clashing, empty_docs):
    out = mixing.mix_documents(docs)
    assert out.columns == docs.columns
    rows = out.collect()
    words = Counter()
    texts = defaultdict(list)
    for r in rows:
        words[r.source] += len(WORD.findall(r.text))
        texts[r.doc_id].append(r.text)
        assert r.n_chars == len(r.text)
    taken = Counter()
    for r in mixing.mix_counts(docs).collect():
        taken[r.source] += r.taken
    assert +words == +taken
    original = {i: WORD.findall(t or "") for i, t, *_ in corpus if i is not None}
    for i, ts in texts.items():
        if i is not None and i != 9:        # 9 is repeated
            assert len(ts) <= 3
            for t in ts:
                assert not Counter(WORD.findall(t)) - Counter(original[i])
    assert mixing.mix_documents(clashing).columns == clashing.columns
    assert mixing.mix_documents(empty_docs).count() == 0 and mixing.mix_counts(empty_docs).count() == 0


def test_slots_fill_output_shards_multinomially(spark):
    t = spark.createDataFrame([("a", 0, 64000, 64000.0)], "source string, rank int, source_size long, target double")
    n = [r["count"] for r in mixing.block_slots(t, 32, 8).groupBy("out_shard").count().collect()]
    assert sum(n) == 2000 and len(n) == 8 and all(abs(x - 250) < 80 for x in n)


def test_no_python_in_the_plan(docs):
    plan = mixing.mix_counts(docs)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
