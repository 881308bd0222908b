"""Fingerprints, links and components against plain Python."""

import random

import numpy as np
import pytest
import xxhash

from binlens.llm import simhash
from binlens.llm.components import connected_components

from llm.conftest import sentence


def plain_fingerprint(text, k=3):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").encode().split()
    if not words:
        return 0
    grams = [b" ".join(words[i:i + k]) for i in range(max(1, len(words) - k + 1))]
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_roots(nodes, linked):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in linked:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


@pytest.mark.parametrize("text", [None, "", "a", "A b", "a b c", "a b c d a b c", "É e f g\th i\n" * 30, "x " * 200_000])
def test_fingerprint(text):
    assert simhash.fingerprint(text.encode() if text is not None else None) == plain_fingerprint(text)


def test_components_match_brute_force(docs, corpus):
    got = simhash.simhash_components(docs).collect()
    assert len(got) == len(corpus)
    fps = {plain_fingerprint(t) for _, t, *_ in corpus}
    roots = plain_roots(fps, [(a, b) for a in fps for b in fps if a < b and (a ^ b).bit_count() <= 2])
    least = {}
    for i, t, *_ in corpus:
        r = roots[plain_fingerprint(t)]
        if i is not None:
            least[r] = min(least.get(r, i), i)
    want = sorted(((i, plain_fingerprint(t), least.get(roots[plain_fingerprint(t)])) for i, t, *_ in corpus), key=str)
    assert sorted(((r.doc_id, r.fp % 2**64, r.component_id) for r in got), key=str) == want


@pytest.mark.parametrize("limit", [0, 3, 64])
def test_hot_blocks_lose_no_link(spark, limit):
    rng = random.Random(limit)
    base = rng.getrandbits(64)
    fps = {base} | {base ^ sum(1 << rng.randrange(64) for _ in range(k % 6)) for k in range(150)} | {rng.getrandbits(64) for _ in range(50)}
    fps = sorted(f % 2**64 for f in fps)
    df = spark.createDataFrame([(int(np.uint64(f).view(np.int64)),) for f in fps], "fp long")
    roots = {r.node % 2**64: r.root % 2**64 for r in connected_components(simhash.close_pairs(df, 2, limit)).collect()}
    want = plain_roots(fps, [(a, b) for a in fps for b in fps if a < b and (a ^ b).bit_count() <= 2])
    groups, plain = {}, {}
    for f in fps:
        groups.setdefault(roots.get(f, f), set()).add(f)
        plain.setdefault(want[f], set()).add(f)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, plain.values()))


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, x) for x in range(101, 140)] + [(140, 139), (5, 5), (1, 0), (None, 3)]
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(61)) and all(got[i] == 100 for i in range(100, 141)) and len(got) == 102


def test_empty_and_clashing(empty_docs, clashing, docs):
    assert simhash.simhash_components(empty_docs).count() == 0
    a = simhash.simhash_components(clashing).collect()
    assert sorted(map(str, a)) == sorted(map(str, simhash.simhash_components(docs).collect()))


def test_one_row_of_each_group_stays(docs, clashing, corpus, empty_docs):
    kept = simhash.drop_near_copies(docs).collect()
    comp = {(r.doc_id, r.root): r.component_id for r in simhash.simhash_components(docs).collect()}
    assert len(kept) == len({r for _, r in comp})
    assert {r.doc_id for r in kept if r.doc_id is not None} == {c for c in comp.values() if c is not None}
    assert simhash.drop_near_copies(clashing).columns == clashing.columns
    assert simhash.drop_near_copies(empty_docs).count() == 0


def test_null_and_repeated_ids_keep_a_row_in_each_component(spark):
    """Rows of one id whose texts lie in different components: every component keeps its own text."""
    rng = random.Random(11)
    texts = [sentence(rng, 60) for _ in range(9)]
    rows = [(None, t) for t in texts[:4]] + [(None, texts[0])]            # four components without ids, one with a copy
    rows += [(5, texts[4]), (5, texts[5]), (5, texts[4])]                 # a repeated id in two components
    rows += [(3, texts[6]), (8, texts[6]), (8, texts[7]), (None, texts[7]), (1, texts[8]), (None, None), (None, "")]
    kept = simhash.drop_near_copies(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    want = [(None, t) for t in texts[:4]] + [(5, texts[4]), (5, texts[5]), (3, texts[6]), (8, texts[7]), (1, texts[8]), (None, "")]
    assert sorted(((r.doc_id, r.text) for r in kept), key=str) == sorted(want, key=str)
