import math
import zlib
from collections import Counter

import numpy as np
import pytest

from binlens.llm import lm_score as L
from binlens.llm.common import words_of


def test_levels_and_counts():
    tau = 3.0
    for c in (3, 4, 5, 100, 12345):
        lv = int(L.levels_of(c, tau))
        got = float(L.level_count(np.array([lv]), tau)[0])
        assert lv >= 1 and c / 1.5 <= got <= c * 1.5
    assert L.level_count(np.array([0]), tau)[0] == 0
    # levels inserted stay within the bound whatever the counts
    n = 10**6
    counts = np.random.default_rng(0).zipf(1.3, 5000).clip(1, n)
    counts = counts[counts >= n * 1e-4]
    assert L.levels_of(counts, n * 1e-4).sum() <= counts.sum() / (n * 1e-4) / (L.BASE - 1)


def plain(corpus):
    train = Counter()
    for i, t, *_ in corpus:
        if zlib.crc32(b"" if i is None else str(i).encode()) % 7 != 2:
            train.update(words_of(t.encode() if t else None) + [b""])
    return train


def test_base_scores_match_brute_force(docs, corpus):
    train = plain(corpus)
    n, v = sum(train.values()), len(train)
    want = []
    for i, t, *_ in corpus:
        toks = words_of(t.encode() if t else None) + [b""]
        want.append((i, zlib.crc32(b"" if i is None else str(i).encode()) % 7 == 2, len(toks), sum(train[w] > 0 for w in toks), n,
                     round(sum(math.log10((train[w] + 1) / (n + v + 1)) for w in toks), 6)))
    got = L.lm_scores(docs).collect()
    assert sorted(((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got), key=str) == sorted(want, key=str)
    assert all(r.score < 0 and math.isfinite(r.score) for r in got)


def test_words_outside_the_vocabulary_are_joined(docs, corpus, monkeypatch):
    """With a vocabulary of a few words nearly every count comes from the join."""
    a = sorted(((r.doc_id, r.n_known, round(r.base_score, 6)) for r in L.lm_scores(docs).collect()), key=str)
    monkeypatch.setattr(L, "VOCABULARY", 0.01)
    b = sorted(((r.doc_id, r.n_known, round(r.base_score, 6)) for r in L.lm_scores(docs).collect()), key=str)
    assert a == b


def test_filter_against_exact_counts(spark, docs, corpus):
    train = plain(corpus)
    words = L.word_counts(docs.where("pmod(crc32(cast(coalesce(string(doc_id), '') as binary)), 7) != 2").select("text"))
    pairs = spark.createDataFrame([(i << 32 | (i + 1), 5 + i) for i in range(2000)], "pair long, c long")
    bloom = L.Filter(L.build_filter(words, pairs, 1.0), 1.0)
    grams = np.array([L._hash_word(w) for w in train], np.uint64)
    exact = L.levels_of(np.array(list(train.values())), 1.0)
    got = bloom.levels(grams)
    assert (got >= exact).all() and (got > exact).mean() < 0.03        # a Bloom filter never undercounts
    absent = L.pair_hash(np.arange(10**6, 10**6 + 20000))
    assert (bloom.levels(absent) > 0).mean() < 0.03
    keys = L.pair_hash(np.array([i << 32 | (i + 1) for i in range(2000)]))
    assert (bloom.levels(keys) >= L.levels_of(np.arange(5, 2005), 1.0)).all()


def test_model_prefers_seen_pairs(spark):
    rows = [(i, "alpha beta gamma delta " * 20) for i in range(60)] + [(100 + i, "alpha gamma beta delta") for i in range(2)]
    rows += [(1000 + i, t) for i, t in enumerate(["alpha beta gamma delta"] * 20)] + [(2000 + i, "delta gamma beta alpha") for i in range(20)]
    got = L.lm_scores(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    held = {r.doc_id: r.score for r in got if r.held_out}
    seen = [s for i, s in held.items() if 1000 <= i < 2000]
    odd = [s for i, s in held.items() if i >= 2000]
    assert seen and odd and min(seen) > max(odd)


def test_odd_tables(docs, clashing, empty_docs):
    assert L.lm_scores(empty_docs).count() == 0
    a = sorted(str((r.doc_id, r.n_tokens, r.n_known, round(r.base_score, 6), round(r.score, 6))) for r in L.lm_scores(clashing).collect())
    b = sorted(str((r.doc_id, r.n_tokens, r.n_known, round(r.base_score, 6), round(r.score, 6))) for r in L.lm_scores(docs).collect())
    assert a == b
    only = docs.where("doc_id = 1 or doc_id = 12").unionAll(empty_docs)
    assert L.lm_scores(only).count() == 2


def plain_scores(corpus):
    """Model scores with the quantised counts of every training word and pair."""
    words, pairs = Counter(), Counter()
    texts = [(i, words_of(t.encode() if t else None) + [b""]) for i, t, *_ in corpus]
    for i, toks in texts:
        if zlib.crc32(b"" if i is None else str(i).encode()) % 7 != 2:
            words.update(toks)
            pairs.update(zip([b""] + toks, toks))
    total = sum(words.values()) + len(words) + 1

    def quantised(c):
        return float(L.level_count(L.levels_of([c], 1.0), 1.0)[0]) if c else 0.0

    out = []
    for i, toks in texts:
        s = 0.0
        for a, b in zip([b""] + toks, toks):
            p, first = (quantised(words[b]) + 1) / total, quantised(words[a])
            if first:
                p = L.PAIR_WEIGHT * min(quantised(pairs[a, b]) / first, 1) + (1 - L.PAIR_WEIGHT) * p
            s += math.log10(min(p, 1))
        out.append((i, len(toks), s))
    return out


def near(got, want, share=0.03):
    """Scores as exact ones but for the filter's false positives."""
    got, want = (sorted(x, key=lambda r: (str(r[0]), r[1], r[2])) for x in (got, want))
    assert [r[:2] for r in got] == [r[:2] for r in want]
    off = [abs(g[2] - w[2]) / abs(w[2]) for g, w in zip(got, want)]
    assert np.mean(off) < share and max(off) < 10 * share


def test_scores_count_every_word_and_pair(docs, corpus, monkeypatch):
    """Nothing is dropped, however small its share of the tokens: shares that a large corpus would have."""
    monkeypatch.setattr(L, "VOCABULARY", 0.01)
    monkeypatch.setattr(L, "THETA", 1e-4, raising=False)
    near([(r.doc_id, r.n_tokens, r.score) for r in L.lm_scores(docs).collect()], plain_scores(corpus))


def test_runs_and_regions_do_not_change_scores(docs, monkeypatch):
    a = sorted(((r.doc_id, r.n_tokens, r.n_known, round(r.base_score, 6), r.score) for r in L.lm_scores(docs).collect()), key=str)
    monkeypatch.setattr(L, "RUN_BYTES", 3000)
    monkeypatch.setattr(L, "REGION_BYTES", 2000)
    b = sorted(((r.doc_id, r.n_tokens, r.n_known, round(r.base_score, 6), r.score) for r in L.lm_scores(docs).collect()), key=str)
    assert [r[:4] for r in a] == [r[:4] for r in b]
    assert np.allclose([r[4] for r in a], [r[4] for r in b], rtol=0.02)
