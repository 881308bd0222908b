import hashlib
import re

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from binlens.llm import fill_middle as M
from binlens.llm.queries import QUERIES

from conftest import SF001


def brute(doc_id, text, rate=100, spm=50):
    text = text or ""
    h = hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[i:i + 8], 16) for i in (0, 8, 16, 24))
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    n = len(units)
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= rate:
        return n, "plain", None, None, text
    x, y = sorted((h1 % (n + 1), h2 % (n + 1)))
    a, b, c = "".join(units[:x]), "".join(units[x:y]), "".join(units[y:])
    if h4 % 100 < spm:
        return n, "spm", len(a), len(b), f"<S>{c}<P>{a}<M>{b}"
    return n, "psm", len(a), len(b), f"<P>{a}<S>{c}<M>{b}"


TEXT = st.one_of(st.none(), st.text(alphabet="ab\n\nëあ\U0001f600<PSM>\x00\x0b", max_size=40))


@settings(max_examples=400, deadline=None)
@given(st.lists(TEXT, max_size=12), st.integers(0, 2**32 - 1), st.integers(0, 2**32 - 1))
def test_cuts_equal_splitting(texts, u, v):
    raw = [None if t is None else t.encode() for t in texts]
    h1, h2 = np.full(len(texts), u), np.full(len(texts), v)
    got = M.cut_texts(raw, h1, h2)
    for i, t in enumerate(texts):
        units = re.findall(r"[^\n]*\n|[^\n]+", t or "")
        x, y = sorted((u % (len(units) + 1), v % (len(units) + 1)))
        a, b = "".join(units[:x]), "".join(units[x:y])
        assert [int(g[i]) for g in got] == [len(units), len(a.encode()), len((a + b).encode()), len(a), len(b)]


@settings(max_examples=300, deadline=None)
@given(st.binary(min_size=1, max_size=60))
def test_rank_and_select(raw):
    words = np.frombuffer(raw + b"\0" * (-len(raw) % 8), "<u8")
    for byte in {raw[0], 0, 10, 255, 128}:
        marks = M.Marks(M.marks_of_byte(words, byte))
        at = [i for i, c in enumerate(raw + b"\0" * (-len(raw) % 8)) if c == byte]
        assert marks.rank(np.arange(len(raw))).tolist() == [sum(p < i for p in at) for i in range(len(raw))]
        if at:
            assert marks.select(np.arange(1, len(at) + 1)).tolist() == at


def test_query_equals_brute_force(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF001}/documents.parquet").collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    rows = QUERIES["op12_fill_middle"](spark, SF001).collect()
    assert len(rows) == len(texts) and {r.form for r in rows} >= {"spm", "psm"}
    for r in rows:
        n, form, pre, mid, out = brute(r.doc_id, texts[r.doc_id])
        assert (r.n, r.form, r.prefix_chars, r.middle_chars, r.output_sha256, r.restored_sha256) == (n, form, pre, mid, sha(out), sha(texts[r.doc_id]))


def test_rates(spark, docs):
    rows = {(r.doc_id, r.output): r for r in M.fill_in_middle(docs.where("doc_id is not null"), rate=40, spm=100).collect()}
    want = {(r.doc_id, brute(r.doc_id, r.text, 40, 100)[4]) for r in docs.where("doc_id is not null").collect()}
    assert set(rows) == want and {r.form for r in rows.values()} == {"plain", "spm"}


def test_round_trip_and_odd_rows(spark, docs, clashing, empty_docs):
    odd = spark.createDataFrame([(None, "a\nb"), (1, None), (1, ""), (2, "\n"), (2, "\n\n\n"), (3, "x<S>y\n"), (4, "é\n" * 50_000 + "z"), (4, "one line " * 60_000),
                                 (5, "a<\nS>b\nP>"), (5, "a<\nS>b\nP>")], "doc_id long, text string")
    for df in (docs.select("doc_id", "text"), odd):
        got = M.fill_in_middle(df).select("doc_id", "form", "n", M.restored(F.col("output"), F.col("form")).alias("t"))
        assert sorted(map(str, got.select("doc_id", "t").collect())) == sorted(str(r) for r in df.select("doc_id", F.coalesce("text", F.lit("")).alias("t")).collect())
    assert {r.form for r in M.fill_in_middle(odd.where("doc_id in (1, 3)")).collect()} == {"plain"}
    assert sorted(map(str, M.fill_in_middle(clashing).collect())) == sorted(map(str, M.fill_in_middle(docs).collect()))
    assert M.fill_in_middle(empty_docs).count() == 0
