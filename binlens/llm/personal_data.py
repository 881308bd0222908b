"""Personal data in texts: patterns propose spans, validators confirm them, context words move the score.

Every rule has a pattern, a validator (Luhn for cards, mod-97 for account numbers, value ranges for the rest),
a score of its own and context words. A confirmed span's score rises when one of the rule's words stands
within ``WINDOW`` code points of it and falls when a word of ``DOUBT`` does. Spans of *base* rules are all
kept, whatever their score; spans of the other rules are kept from ``THRESHOLD`` on, unless they overlap a base span
or a kept span that scores as much or more.

All patterns scan in linear time: a run of characters that cannot start a match is never scanned from each
of its positions. Offsets are code points, ends exclusive.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Code points before and after a span in which context words count.
WINDOW = 40
THRESHOLD = 0.5
BOOST, DROP = 0.4, 0.3
#: Words beside which a number is seldom personal.
DOUBT = ("order", "invoice", "isbn", "version", "serial", "article", "figure", "page")
_WORD = re.compile(r"[^\W\d_]+")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def mod97(account: str) -> bool:
    """International account numbers: country and check digits moved to the end, letters as 10 to 35."""
    turned = account[4:] + account[:4]
    return int("".join(str(int(c, 36)) for c in turned)) % 97 == 1


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def _octets(s: str) -> bool:
    parts = [p.lstrip("0") for p in s.split(".")]
    return all(len(p) <= 3 and int(p or 0) <= 255 for p in parts)


def _card(least: int, most: int) -> Callable[[str], bool]:
    def ok(s: str) -> bool:
        d = _digits(s) if len(s) <= 2 * most else ""
        return least <= len(d) <= most and luhn(d)
    return ok


def _account(s: str) -> bool:
    s = s.replace(" ", "")
    return 15 <= len(s) <= 34 and mod97(s)


def _social(s: str) -> bool:
    area, group, serial = s.split("-")
    return area not in ("000", "666") and area < "900" and group != "00" and serial != "0000"


@dataclass(frozen=True)
class Rule:
    kind: str
    pattern: re.Pattern
    valid: Callable[[str], bool]
    score: float
    words: tuple[str, ...]
    base: bool = False


_AT = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_HAS_DIGIT = re.compile(r"[0-9]")

#: In the order in which kinds sort at equal starts. The e-mail rule's pattern is the part from @ on.
RULES = (
    Rule("email", _AT, lambda s: True, 0.9, ("mail", "email", "contact", "write"), True),
    # A match never starts inside a run of digits: it would have started with the run.
    Rule("ip", re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}"), _octets, 0.6, ("ip", "address", "host", "server", "login"), True),
    # Chains of digits with one space or hyphen between them are matched whole.
    Rule("card", re.compile(r"[0-9](?:[ -]?+[0-9]){13,}+"), _card(14, 19), 0.8, ("card", "visa", "credit", "debit", "payment"), True),
    Rule("phone", re.compile(r"\+[0-9][ ().0-9-]+[0-9]"), lambda s: 10 <= len(_digits(s)) <= 15, 0.7, ("phone", "tel", "call", "mobile", "fax"), True),
    Rule("iban", re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"), _account, 0.6,
         ("iban", "account", "bank", "konto", "compte", "cuenta")),
    Rule("ssn", re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"), _social, 0.3, ("ssn", "social", "security")),
    Rule("short_card", re.compile(r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){11,12}(?![ -]?[0-9])"), _card(12, 13), 0.3,
         ("card", "visa", "credit", "debit", "payment")),
    Rule("local_phone", re.compile(r"(?<![0-9+.-])\(?[0-9]{2,4}\)?[ .-][0-9]{3,4}[ .-][0-9]{3,4}(?![0-9.-]*[0-9])"), lambda s: 8 <= len(_digits(s)) <= 12,
         0.3, ("phone", "tel", "telefon", "call", "mobile", "fax", "ring")),
)
KINDS = tuple(r.kind for r in RULES)
_ORDER = {k: i for i, k in enumerate(KINDS)}


def _addresses(text: str):
    """Matches of ``[local]+@[domain]``: the run of local characters before each @, from the last match on."""
    end = 0
    for m in _AT.finditer(text):
        at = m.start()
        head = text[max(end, text.rfind("@", end, at) + 1):at]
        local = len(head) - len(head.rstrip(_LOCAL))
        if local:
            end = m.end()
            yield at - local, end


def _proposed(rule: Rule, text: str):
    if rule.kind == "email":
        yield from _addresses(text)
        return
    for m in rule.pattern.finditer(text):
        if rule.valid(m.group()):
            yield m.span()


def _scored(rule: Rule, text: str, start: int, end: int) -> float:
    near = _WORD.findall((text[max(0, start - WINDOW):start] + " " + text[end:end + WINDOW]).lower())
    score = rule.score + BOOST * any(w in rule.words for w in near) - DROP * any(w in DOUBT for w in near)
    return round(min(1.0, max(0.0, score)), 2)


def personal_spans(text: str | None, threshold: float = THRESHOLD) -> list[tuple[str, int, int, float, bool]]:
    """(kind, start, end, score, base) by start, then kind."""
    if not text:
        return []
    digits = _HAS_DIGIT.search(text) is not None
    kept, more = [], []
    for rule in RULES:
        if "@" not in text if rule.kind == "email" else not digits:
            continue
        for start, end in _proposed(rule, text):
            span = (rule.kind, start, end, _scored(rule, text, start, end), rule.base)
            if rule.base:
                kept.append(span)
            elif span[3] >= threshold:
                more.append(span)
    if more:
        more.sort(key=lambda s: (-s[3], s[1], _ORDER[s[0]]))
        taken = _Taken((s[1], s[2]) for s in kept)
        kept += [s for s in more if taken.take(s[1], s[2])]
    return sorted(kept, key=lambda s: (s[1], _ORDER[s[0]], s[2]))


class _Taken:
    """Ranges already taken, held by blocks of the text, so that a test looks at near ranges only."""

    def __init__(self, ranges, block: int = 256):
        self.block, self.by = block, {}
        for a, b in ranges:
            self._add(a, b)

    def _blocks(self, a, b):
        return range(a // self.block, (b - 1) // self.block + 1)

    def _add(self, a, b):
        for k in self._blocks(a, b):
            self.by.setdefault(k, []).append((a, b))

    def take(self, a: int, b: int) -> bool:
        if any(x < b and a < y for k in self._blocks(a, b) for x, y in self.by.get(k, ())):
            return False
        self._add(a, b)
        return True


_SPAN = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64()), ("base", pa.bool_())])
SPANS = "spans array<struct<kind string, start bigint, end bigint, score double, base boolean>>"


def find_personal(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep_text: bool = False,
                  threshold: float = THRESHOLD) -> DataFrame:
    """(id_col, spans [, text]) for every row of ``docs``: one pass, nothing shuffled, texts whole.

    Null and empty texts have no spans; null ids and repeated rows are kept row by row; an empty table gives
    no rows; other columns are not read, so their names do not matter.
    """
    src = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))

    def run(batches):
        for b in batches:
            found = [[dict(zip(("kind", "start", "end", "score", "base"), s)) for s in personal_spans(t.as_py(), threshold)]
                     for t in b.column(1)]
            cols = [b.column(0), pa.array(found, pa.list_(_SPAN))] + ([b.column(1)] if keep_text else [])
            yield pa.RecordBatch.from_arrays(cols, names=["id", "spans"] + ["text"] * keep_text)

    kind = src.schema["id"].dataType.simpleString()
    out = src.mapInArrow(run, f"id {kind}, {SPANS}" + ", text string" * keep_text)
    names = {"id": id_col, "text": text_col}
    return out.toDF(*[names.get(c, c) for c in out.columns])


def listed(spans: Column) -> Column:
    """``kind:start:end`` of every span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def count_of(spans: Column, kind: str) -> Column:
    """Base spans of one kind."""
    return F.size(F.filter(spans, lambda s: s["base"] & (s["kind"] == kind))).cast("bigint")


def redact(text: Column, spans: Column) -> Column:
    """The text with every span replaced by ``[kind]``; of overlapping spans the first names the gap."""
    start = F.struct(F.lit(0).cast("bigint").alias("at"), F.lit("").alias("out"))

    def step(acc, s):
        covered = s["end"] <= acc["at"]
        gap = F.when(s["start"] >= acc["at"], F.concat(F.substr(text, acc["at"] + 1, s["start"] - acc["at"]), F.lit("["), s["kind"], F.lit("]"))).otherwise(F.lit(""))
        return F.struct(F.when(covered, acc["at"]).otherwise(s["end"]).alias("at"), F.when(covered, acc["out"]).otherwise(F.concat(acc["out"], gap)).alias("out"))

    return F.aggregate(spans, start, step, lambda acc: F.concat(acc["out"], F.substr(text, acc["at"] + 1)))
