import random
import zlib

import numpy as np
import pytest

from binlens.llm import toxicity as T

from conftest import SF01


def examples(n, seed):
    """Toxic: an insult together with a group mention; either alone is not."""
    rng = random.Random(seed)
    texts, labels = [], []
    for _ in range(n):
        words = ["".join(rng.choices("abcdefgh", k=4)) for _ in range(30)]
        a, b = rng.random() < 0.5, rng.random() < 0.5
        words += ["insultword"] * a + ["groupname"] * b
        rng.shuffle(words)
        texts.append(" ".join(words).encode())
        labels.append(int(a and b))
    return texts, np.array(labels)


def test_pairs_are_learnt():
    texts, labels = examples(1500, 1)
    held, want = examples(400, 2)
    got = T.fit_machine(texts, labels, passes=400).scores(held, {})
    assert ((got >= 0.5) == want).mean() > 0.97


def test_margin_is_the_sum_over_pairs():
    rng = np.random.default_rng(0)
    m = T.Machine(np.array([3, 9, 40]), rng.normal(size=3), rng.normal(size=(3, 4)), 0.2)
    got, _ = m.margins(np.array([0, 0, 0, 1]), np.array([0, 1, 2, 1]), 3)
    want = 0.2 + m.w.sum() + m.v[0] @ m.v[1] + m.v[0] @ m.v[2] + m.v[1] @ m.v[2]
    assert got == pytest.approx([want, 0.2 + m.w[1], 0.2])


def test_one_class_and_no_rows():
    assert T.fit_machine([b"a"] * 5, np.zeros(5)).scores([b"x", None], {}).tolist() == pytest.approx([1 / 12, 1 / 12])
    assert 0 < T.fit_machine([], np.array([])).scores([None], {})[0] < 1


def test_whole_text_counts():
    texts, labels = examples(1500, 1)
    m = T.fit_machine(texts, labels, passes=400)
    filler = " ".join("w%d" % i for i in range(100)) + " "
    long = (filler * 2000 + "insultword groupname").encode()
    assert m.scores([long], {})[0] > 0.5 > m.scores([(filler * 2000).encode()], {})[0]


def test_held_out_accuracy_on_labelled_rows(spark):
    docs, labels = (spark.read.parquet(f"{SF01}/{t}.parquet") for t in ("documents", "labels"))
    rows = T.toxicity_scores(docs, labels).join(labels, "doc_id").collect()
    held = [r for r in rows if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    pos, neg = ([r.score for r in held if r.toxic == y] for y in (1, 0))
    auc = np.mean([(a > b) + 0.5 * (a == b) for a in pos for b in neg])
    assert auc > 0.9 and np.mean([r.predicted == r.toxic for r in held]) > 0.93
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)


def test_odd_rows(spark, docs, clashing, empty_docs):
    labels = spark.createDataFrame([(1, 1, "x"), (2, 0, "y"), (2, 0, "y"), (3, None, "z"), (None, 1, "q"), (6, 7, "r")], "doc_id long, toxic int, text string")
    a = T.toxicity_scores(docs, labels)
    assert a.count() == docs.count() and a.where("score is null or held_out is null").count() == 0
    assert sorted(map(str, T.toxicity_scores(clashing, labels).collect())) == sorted(map(str, a.collect()))
    assert T.toxicity_scores(empty_docs, labels).count() == 0
    assert T.toxicity_scores(docs, labels.limit(0)).count() == docs.count()


def test_no_telling_term():
    m = T.fit_machine([b"alpha", b"beta"], np.array([0, 1]))
    assert m.scores([b"alpha", b"other", b"", None], {}) == pytest.approx([0.5] * 4, abs=1e-3)


def both_or_neither(n, seed):
    texts, _ = examples(n, seed)
    return texts, np.array([int((b"insultword" in t) == (b"groupname" in t)) for t in texts])


def test_pairs_whose_words_tell_nothing_alone():
    texts, labels = both_or_neither(2000, 1)
    held, want = both_or_neither(600, 2)
    got = T.fit_machine(texts, labels).scores(held, {})
    auc = np.mean([(a > b) + 0.5 * (a == b) for a in got[want == 1] for b in got[want == 0]])
    assert auc > 0.9


def test_interactions_by_brute_force():
    rng = np.random.default_rng(3)
    x = rng.random((300, 7)) < [0.5, 0.4, 0.6, 0.5, 0.3, 0.01, 1.0]       # one term too rare, one in every text
    labels = (x[:, 0] ^ x[:, 1]).astype(float)
    row, term = np.nonzero(x)
    terms, z2 = T.interactions(row, term, labels, block=2)
    assert terms.tolist() == [0, 1, 2, 3, 4]
    for i in terms:
        want = 0.0
        for j in set(terms) - {i}:
            cells = [labels[(x[:, i] == u) & (x[:, j] == v)] for u in (True, False) for v in (True, False)]
            rate = [(c.sum() + 0.5) / (len(c) + 1) for c in cells]
            if min(map(len, cells)) >= 5:
                spread = sum(r * (1 - r) / (len(c) + 1) for r, c in zip(rate, cells))
                want = max(want, (rate[0] - rate[1] - rate[2] + rate[3]) ** 2 / spread)
        assert z2[i] == pytest.approx(want, rel=1e-3)
    assert set(np.argsort(-z2)[:2]) == {0, 1}
    assert all(len(v) == 0 for v in T.interactions(row[:0], term[:0], np.zeros(0)))


def test_terms_of_a_sample_by_chunks():
    texts = [b"a bcde fghijk", None, b"", b"xx yyyyy a"] * 200
    for got, want in zip(T.sample_terms(texts, chunk=7), T.text_terms(texts, {})):
        assert got.tolist() == want.tolist()
    assert [len(v) for v in T.sample_terms([])] == [0, 0]
