import random

import numpy as np
import pytest

from binlens.llm import decontaminate as D

from llm.conftest import sentence


def best_edits(text, item):
    """Sellers: least edits of the whole item against any region of the text."""
    row = [0] * (len(text) + 1)
    for i, c in enumerate(item):
        new = [i + 1]
        for j, t in enumerate(text):
            new.append(min(row[j] + (c != t), row[j + 1] + 1, new[j] + 1))
        row = new
    return min(row)


def edited(rng, text, n):
    t = list(text)
    for _ in range(n):
        i = rng.randrange(len(t))
        x = rng.random()
        if x < 0.34:
            t[i] = rng.choice("xyzq")
        elif x < 0.67:
            del t[i]
        else:
            t.insert(i, rng.choice("xyzq"))
    return "".join(t)


@pytest.mark.parametrize("seed", range(6))
def test_contained_items_match_brute_force(seed):
    rng = random.Random(seed)
    items = [(i, sentence(rng, rng.randint(8, 25))) for i in range(6)]
    texts = []
    for k in range(24):
        item = items[k % 6][1]
        e = D.edit_budget(len(item), D.BUDGET)
        inside = edited(rng, item, rng.choice([0, 1, e // 2, e, e + 1, 2 * e + 3]))
        texts.append(D.normalised((sentence(rng, rng.randint(0, 30)) + " " + inside + " " + sentence(rng, rng.randint(0, 30))).encode()))
    # hardly changed items are found at either end of a text
    texts += ["", "short", D.normalised(items[0][1].encode()), " ".join(t for _, t in items)]
    got = {(d, i): c for d, i, _, _, c in D.Items(items).matches(texts)}
    want = {}
    index = D.Items(items)
    for d, t in enumerate(texts):
        for n, (i, item) in enumerate(items):
            c = best_edits(t, D.normalised(item.encode()))
            if c <= index.edits[n]:
                want[d, i] = c
    assert got == want


def test_spans_are_the_regions():
    rng = random.Random(9)
    items = [(7, sentence(rng, 20))]
    lead = sentence(rng, 15) + " "
    (d, i, a, b, c), = D.Items(items).matches([lead + items[0][1].upper().lower() + " end"])
    assert (d, i, c) == (0, 7, 0) and (lead + items[0][1])[a:b] == items[0][1]


def test_tiny_items_and_runs_of_one_letter():
    items = D.Items([(1, "abc"), (2, "a" * 60), (3, "  "), (4, "")])
    got = {(d, i) for d, i, *_ in items.matches(["xxabcxx", "a" * 300, "b" * 300, "ABC".lower()])}
    assert got == {(0, 1), (1, 2), (3, 1)}


def test_grams_by_doubling():
    p = D.code_points("überall hin und zurück " * 3)
    direct = np.zeros(len(p) - 7, np.uint64)
    for i in range(8):
        direct = direct * D._BASE + (p[i:len(p) - 7 + i].astype(np.uint64) + np.uint64(1))
    assert (D.gram_hashes(p, 8) == direct).all() and len(D.gram_hashes(p[:7], 8)) == 0


@pytest.fixture(scope="module")
def benchmark(spark, corpus):
    words = corpus[20][1].split()
    rows = [(1, " ".join(words[10:35]), "x"), (2, None, "x"), (3, "  ", "x"), (4, "Never Seen " * 12, "x"), (None, " ".join(words[40:60]).upper(), "x")]
    return spark.createDataFrame(rows, "item_id long, text string, id string")


def test_documents(docs, clashing, empty_docs, benchmark, corpus):
    got = sorted((r.doc_id, r.item_id or 0, r.edits) for r in D.find_leaks(docs, benchmark).collect())
    assert got == [(20, 0, 0), (20, 1, 0)]
    kept = D.drop_leaks(docs, benchmark)
    assert kept.columns == docs.columns and kept.count() == len(corpus) - 1 and kept.where("doc_id = 20").count() == 0
    assert D.drop_leaks(clashing, benchmark).columns == clashing.columns
    assert D.find_leaks(empty_docs, benchmark).count() == 0
    assert D.find_leaks(docs, benchmark.limit(0)).count() == 0 and D.drop_leaks(docs, benchmark.limit(0)).count() == len(corpus)


def test_benchmark_in_parts(benchmark):
    parts = list(D.item_parts(benchmark, "item_id", "text", 150))
    assert sum(map(len, parts)) == 3 and len(parts) > 1


def test_planted_benchmark_items_are_found(spark):
    import duckdb

    from conftest import SF01
    from binlens.llm.queries import QUERIES
    got = {(r.doc_id, r.item_id) for r in QUERIES["op10_decontamination"](spark, SF01).collect()}
    whole = set(duckdb.sql(f"select doc_id, item_id from '{SF01}/documents.parquet' d, '{SF01}/benchmark.parquet' b where contains(d.text, b.text)").fetchall())
    assert whole and whole <= got and len(got) <= len(whole) + 2


@pytest.mark.parametrize("length", [60, 100, 394])
def test_documents_that_are_cuts_of_items(length):
    """Prefixes, suffixes and middles of an item, of every length: contained only within the budget."""
    rng = random.Random(length)
    item = D.normalised(sentence(rng, length)[:length].encode())
    items = D.Items([(1, item)])
    e, m = int(items.edits[0]), len(item)
    cuts = {item[a:a + n] for n in (*range(m - 2 * e - 4, m + 1), m // 2, m - 54, D.Q, 1) if n > 0 for a in (0, (m - n) // 2, m - n)}
    texts = sorted({D.normalised(t.encode()) for t in cuts} - {""})
    got = {d: c for d, _, _, _, c in items.matches(texts)}
    assert got == {d: c for d, c in ((d, best_edits(t, item)) for d, t in enumerate(texts)) if c <= e}
    assert any(len(t) < m - e - 1 for t in texts)


def test_a_document_that_is_a_cut_does_not_fail_the_job(spark):
    item = sentence(random.Random(4), 59)
    docs = spark.createDataFrame([(1, item), (2, " ".join(item.split()[:50])), (3, " ".join(item.split()[5:55]))], "doc_id long, text string")
    benchmark = spark.createDataFrame([(7, item)], "item_id long, text string")
    assert sorted(r.doc_id for r in D.drop_leaks(docs, benchmark).collect()) == [2, 3]
