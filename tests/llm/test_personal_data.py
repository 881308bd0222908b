import hashlib
import random
import re
import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from binlens.llm import personal_data as P
from binlens.llm.queries import QUERIES

from conftest import SF001

BASE = ("email", "ip", "card", "phone")


def luhn(d):
    return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(d[::-1])) % 10 == 0


def brute(text):
    """The base spans by the plain patterns, as they are stated."""
    found = []
    digits = lambda s: re.sub("[^0-9]", "", s)
    rules = {
        "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda s: True),
        "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda s: all(int(p) <= 255 for p in s.split("."))),
        "card": (r"[0-9]([\x20-]?[0-9])+", lambda s: 14 <= len(digits(s)) <= 19 and luhn(digits(s))),
        "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda s: 10 <= len(digits(s)) <= 15)}
    for k, (pattern, ok) in rules.items():
        found += [(m.start(), BASE.index(k), k, m.end()) for m in re.finditer(pattern, text or "") if ok(m.group())]
    return [f"{k}:{a}:{b}" for a, _, k, b in sorted(found)]


def base(text):
    return [f"{k}:{a}:{b}" for k, a, b, _, is_base in P.personal_spans(text) if is_base]


@settings(max_examples=1500, deadline=None)
@given(st.text(alphabet="aZ9@@..-_+ (1234\n,é", max_size=60))
def test_base_spans_equal_the_plain_patterns(text):
    assert base(text) == brute(text)


def test_many_shapes_equal_the_plain_patterns():
    rng = random.Random(1)
    pieces = ["a.b@c.d", "x@y", "@a.b@c.d.e", "1.2.3.4.5.6.7.8", "256.1.1.1", "0001.002.3.255", "4111111111111111", "4111 1111-1111 1111", "+1 (523) 555-1055",
              "+1..", "+", "12", "-", " ", "\t", "é@è.fr", "%_@a-b.c-", "5500005555555559", "4222222222222 ", "+49 30 1234567890123", "..", "@"]
    for _ in range(3000):
        text = "".join(rng.choices(pieces, k=rng.randint(1, 9)))
        assert base(text) == brute(text), text


@pytest.mark.parametrize("text", ["a" * 400_000, "1" * 400_000, "1 " * 200_000, "@" * 200_000, "a@" * 200_000, "1." * 200_000, "+1 " * 100_000, "+1" + " ." * 200_000,
                                  "a@b" * 100_000, "AB12" * 100_000, "a." * 150_000 + "@b.c"], ids=lambda t: t[:4])
def test_long_runs_take_linear_time(text):
    t0 = time.time()
    P.personal_spans(text)
    assert time.time() - t0 < 3


def test_validators():
    assert P.luhn("4111111111111111") and not P.luhn("4111111111111112")
    assert P.mod97("GB82WEST12345698765432") and not P.mod97("GB82WEST12345698765433")


def kinds(text):
    return [s[0] for s in P.personal_spans(text)]


def test_checksums_and_context_decide_on_more_spans():
    assert kinds("pay to GB82 WEST 1234 5698 7654 32 now") == ["iban"]
    assert kinds("pay to GB82 WEST 1234 5698 7654 33 now") == []
    assert kinds("her social security number 123-45-6789") == ["ssn"] and kinds("part 123-45-6789") == [] and kinds("ssn 000-45-6789") == []
    assert kinds("call 020 7946 0018 today") == ["local_phone"] and kinds("sum 020 7946 0018 today") == []
    assert kinds("visa 4222222222222") == ["short_card"] and kinds("order of visa 4222222222222") == [] and kinds("visa 4222222222223") == []
    assert kinds("phone +1 (523) 555-1055") == ["phone"]            # no second span inside
    a, b = (P.personal_spans(t)[0][3] for t in ("server 10.0.0.1", "version 10.0.0.1"))
    assert a > b and kinds("version 10.0.0.1") == ["ip"]             # base spans stay whatever their score


def test_query_equals_brute_force(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF001}/documents.parquet").collect()}
    rows = QUERIES["op11_personal_data"](spark, SF001).collect()
    assert len(rows) == len(texts) and sum(r.n_card + r.n_email + r.n_ip + r.n_phone for r in rows) > 5
    for r in rows:
        want = brute(texts[r.doc_id])
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(w.startswith(k + ":") for w in want) for k in BASE]
        assert r.base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest()
        assert [s for s in r.spans.split(",") if s.split(":")[0] in BASE] == want


def test_odd_rows(spark, docs, clashing, empty_docs):
    a = P.find_personal(docs)
    assert a.count() == docs.count() and a.where("spans is null").count() == 0
    assert sorted(map(str, P.find_personal(clashing).collect())) == sorted(map(str, a.collect()))
    assert P.find_personal(empty_docs).count() == 0
    odd = spark.createDataFrame([(None, "a@b.c"), (1, None), (1, ""), (2, "x " * 100_000 + "10.1.2.3"), (2, "\U0001f600 a@b.c")], "doc_id long, text string")
    got = sorted((str(r.doc_id), [(s.kind, s.start, s.end) for s in r.spans]) for r in P.find_personal(odd).collect())
    assert got == [("1", []), ("1", []), ("2", [("email", 2, 7)]), ("2", [("ip", 200000, 200008)]), ("None", [("email", 0, 5)])]


def test_redaction(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(1, "é mail a@b.c or +1 (523) 555-1055."), (2, ""), (3, "4111111111111111")], "doc_id long, text string")
    found = P.find_personal(df, keep_text=True).select("doc_id", P.redact(F.col("text"), F.col("spans")).alias("t"))
    assert {r.doc_id: r.t for r in found.collect()} == {1: "é mail [email] or [phone].", 2: "", 3: "[card]"}
