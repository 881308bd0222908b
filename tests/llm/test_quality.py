import random
import re
from collections import Counter

import numpy as np
import pytest

from binlens.llm import quality

from conftest import SF01

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_stats(text):
    words = WORD.findall(text or "")
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    grams = [tuple(words[i:i + 3]) for i in range(len(words) - 2)]
    n = Counter(grams)
    inside = {i + k for i, g in enumerate(grams) if n[g] > 1 for k in range(3)}
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(inside))


@pytest.mark.parametrize("text", [None, "", " \n ", "a", "a b c a b c", "é ß#\n\né ß#\nx|y", "a a a a", "a b c\x0bd", "l\nl\n l\nl"])
def test_statistics(text):
    assert quality.text_stats(text.encode() if text is not None else None) == plain_stats(text)


def test_statistics_on_random_words():
    rng = random.Random(0)
    for n in (3, 50, 4000):
        t = " ".join(rng.choice("abcdefg") for _ in range(n))
        assert quality.text_stats(t.encode()) == plain_stats(t)


def test_base_and_verdict(spark, docs, corpus):
    got = quality.quality_verdicts(docs).collect()
    assert len(got) == len(corpus)
    want = sorted((str((i, *plain_stats(t))) for i, t, *_ in corpus))
    assert sorted(str((r.id, *[r[c] for c in quality.STATS])) for r in got) == want
    for r in got:
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
        assert r.kept == (not r.base_failed and r.distance <= 70) and r.kept is not None


def plain_mcd(x, share, steps):
    """Concentration steps on one group, with the operator's grid for quantiles."""
    med = (np.floor(np.quantile(x, 0.5, axis=0, method="inverted_cdf") * 512) + 0.5) / 512
    dev = np.abs(x - med)
    mad = (np.floor(np.quantile(dev, 0.5, axis=0, method="inverted_cdf") * 512) + 0.5) / 512
    mean, inv = med, np.diag(1 / ((1.4826 * mad) ** 2 + quality.FLOOR**2))
    for _ in range(steps):
        d = np.einsum("ij,jk,ik->i", x - mean, inv, x - mean)
        cell = np.floor(np.log2(np.maximum(d, 0) + 1e-12) * quality.GRID)
        near = x[cell <= np.sort(cell)[int(np.ceil(share * len(x))) - 1]]
        mean = near.mean(0)
        inv = np.linalg.inv(np.cov(near.T, bias=True) + np.diag(quality.FLOOR**2))
    return mean, inv


def test_estimates_match_a_plain_group(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(400, 5)) @ rng.normal(size=(5, 5)) + 3
    x[:40] += 40
    rows = spark.createDataFrame([("en", "s", *map(float, r)) for r in x], "lang string, source string, " + ", ".join(f"{c} double" for c in quality.X))
    est = {r.level: r for r in quality.mcd_estimates(rows).collect()}
    mean, inv = plain_mcd(x, 0.75, 5)
    for level in (0, 1, 2):
        assert est[level].rows == 400
        assert np.allclose(est[level].mean, mean, atol=1e-6) and np.allclose(np.reshape(est[level].inv, (5, 5)), inv, rtol=1e-4)


def test_junk_goes_and_prose_stays(spark):
    import random
    rng = random.Random(5)
    prose = lambda n: " ".join("".join(rng.choices("abcdefghijklmnop", k=rng.randint(2, 9))) for _ in range(n))
    rows = [(i, prose(rng.randint(60, 400)), "en", f"s{i % 2}") for i in range(300)]
    rows += [(1000 + i, " ".join(w + "***" for w in prose(100).split()), "en", "s0") for i in range(20)]
    rows += [(2000 + i, prose(100).replace(" ", " | "), "en", "s1") for i in range(20)]
    got = {r.id: r.kept for r in quality.quality_verdicts(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    assert all(got[i] for i in range(300))
    assert not any(v for i, v in got.items() if i >= 1000)


def test_labelled_quality(spark):
    docs, labels = (spark.read.parquet(f"{SF01}/{t}.parquet") for t in ("documents", "labels"))
    got = quality.quality_verdicts(docs).where("not base_failed").join(labels, labels.doc_id == quality.F.col("id"))
    good, bad = (got.where(f"quality = {q}") for q in (1, 0))
    assert good.where("kept").count() >= 0.99 * good.count()
    assert bad.where("not kept").count() >= 0.7 * bad.count()


def test_filter_keeps_rows_whole(docs, clashing, empty_docs):
    kept = quality.keep_good(docs)
    good = quality.quality_verdicts(docs).where("kept").count()
    assert kept.columns == docs.columns and kept.count() == good > 50
    assert quality.keep_good(clashing).columns == clashing.columns
    assert quality.keep_good(clashing).count() == good
    assert quality.keep_good(empty_docs).count() == 0 and quality.quality_verdicts(empty_docs).count() == 0
