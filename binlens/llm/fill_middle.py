"""Fill-in-the-middle transformation at line boundaries, found by arithmetic on 64-bit words.

The UTF-8 bytes of a run of texts are one array of little-endian 64-bit words. Arithmetic on whole words
marks the bytes that end a unit (a line feed, and the last byte of a text that has none there) and those that
begin a code point; ``bitwise_count`` counts the marks of each word, and running sums of the counts answer

* *rank*: marks before a byte, from the sum before its word and the masked word;
* *select*: the byte of the k-th mark, by a binary search for the word, then inside it: multiplying the marks by
  0x0101... leaves in each byte the marks up to it, so the bytes with fewer than k of them count the place.

No text is decoded or split; every text is used whole, and nothing is shuffled.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from binlens.llm.common import text_runs, utf8

P, S, M = b"<P>", b"<S>", b"<M>"
#: Bytes of text in one array of words.
RUN_BYTES = 8_000_000
_ONES, _LOW7, _HIGH = np.uint64(0x0101010101010101), np.uint64(0x7F7F7F7F7F7F7F7F), np.uint64(0x8080808080808080)
_U = np.uint64


def marks_of_byte(words: np.ndarray, byte: int) -> np.ndarray:
    """0x80 in every byte equal to ``byte`` (exact: no borrow passes from byte to byte)."""
    x = words ^ (_ONES * _U(byte))
    return ~(((x & _LOW7) + _LOW7) | x | _LOW7)


def marks_of_starts(words: np.ndarray) -> np.ndarray:
    """0x80 in every byte that begins a code point (its top bits are not 10)."""
    return ~(words & ~(words << _U(1))) & _HIGH


class Marks:
    """Rank and select over marked bytes."""

    def __init__(self, marks: np.ndarray):
        self.marks = np.append(marks, _U(0))
        self.upto = np.cumsum(np.bitwise_count(self.marks).astype(np.int64))

    def rank(self, at: np.ndarray) -> np.ndarray:
        """Marks in the bytes before ``at``."""
        word, bits = at >> 3, (at & 7).astype(np.uint64) << _U(3)
        inside = self.marks[word] & ((_U(1) << bits) - _U(1))
        return np.where(word > 0, self.upto[word - 1], 0) + np.bitwise_count(inside)

    def select(self, k: np.ndarray) -> np.ndarray:
        """The byte that holds the k-th mark (from 1)."""
        word = np.minimum(np.searchsorted(self.upto, k, side="left"), len(self.upto) - 1)
        left = (k - np.where(word > 0, self.upto[word - 1], 0)).astype(np.uint64)
        upto = (self.marks[word] >> _U(7)) * _ONES                      # each byte: marks up to and with it
        enough = ((upto | _HIGH) - left * _ONES) & _HIGH                # 0x80 where there are k or more
        return word * 8 + 8 - np.bitwise_count(enough)


def words_of_run(texts: list[bytes | None]) -> tuple[bytes, np.ndarray, np.ndarray]:
    """The texts in one buffer, as words, and where each begins (one more entry: the end)."""
    raw = b"".join(t or b"" for t in texts)
    at = np.cumsum([0, *(len(t) if t else 0 for t in texts)])
    return raw, np.frombuffer(raw + b"\0" * (-len(raw) % 8), "<u8"), at


def unit_marks(words: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Line feeds, and the last byte of every text."""
    marks = marks_of_byte(words, 10)
    last = at[1:][at[1:] > at[:-1]] - 1
    np.bitwise_or.at(marks, last >> 3, _U(0x80) << ((last & 7).astype(np.uint64) << _U(3)))
    return marks


def cut_texts(texts: list[bytes | None], h1: np.ndarray, h2: np.ndarray):
    """(units, first cut, second cut, code points before the first cut, between the cuts), cuts as bytes of each text."""
    _, words, at = words_of_run(texts)
    ends, starts = Marks(unit_marks(words, at)), Marks(marks_of_starts(words))
    a, b = at[:-1], at[1:]
    base = ends.rank(a)
    n = ends.rank(b) - base
    cuts = []
    for units in (np.minimum(h1 % (n + 1), h2 % (n + 1)), np.maximum(h1 % (n + 1), h2 % (n + 1))):
        cuts.append(np.where(units > 0, ends.select(np.maximum(base + units, 1)) + 1, a))
    x, y = cuts
    return n, x - a, y - a, starts.rank(x) - starts.rank(a), starts.rank(y) - starts.rank(x)


def arranged(text: bytes, x: int, y: int, form: str) -> bytes:
    if form == "psm":
        return b"".join((P, text[:x], S, text[y:], M, text[x:y]))
    return b"".join((S, text[y:], P, text[:x], M, text[x:y]))


def draws(id_col: Column, seed: int) -> list[Column]:
    """Four 32-bit numbers from sha256 of ``<seed>:<id>``; a null id counts as no digits."""
    h = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(id_col.cast("string"), F.lit(""))).cast("binary"), 256)
    return [F.conv(F.substring(h, 8 * i + 1, 8), 16, 10).cast("bigint") for i in range(4)]


def fill_in_middle(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = 7, rate: int = 100,
                   spm: int = 50) -> DataFrame:
    """(id_col, n, form, prefix_chars, middle_chars, output) for every row of ``docs``.

    ``rate`` and ``spm`` are percentages: of texts that are cut, and of those that put the suffix first. A text
    that is empty, null (it counts as empty) or holds one of the three marks stays ``plain``. Repeated rows
    get the same cuts; null ids share one draw; an empty table gives no rows; other columns are not read.
    """
    h = draws(F.col(id_col), seed)
    src = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), *[c.alias(f"h{i + 1}") for i, c in enumerate(h)])

    def run(batches):
        for b in batches:
            raw = [t or b"" for t in utf8(b, "text")]
            h1, h2, h3, h4 = (b.column(i).to_numpy() for i in range(2, 6))
            for lo, hi in text_runs(raw, RUN_BYTES):
                texts = raw[lo:hi]
                n, x, y, pre, mid = cut_texts(texts, h1[lo:hi], h2[lo:hi])
                form = ["plain" if not t or u >= rate or any(m in t for m in (P, S, M)) else "spm" if v < spm else "psm"
                        for t, u, v in zip(texts, h3[lo:hi] % 100, h4[lo:hi] % 100)]
                plain = np.array([f == "plain" for f in form])
                out = [t if f == "plain" else arranged(t, i, j, f) for t, i, j, f in zip(texts, x.tolist(), y.tolist(), form)]
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(lo, hi - lo), pa.array(n, pa.int64()), pa.array(form), pa.array(pre, pa.int64(), mask=plain),
                     pa.array(mid, pa.int64(), mask=plain), pa.array(out, pa.binary()).view(pa.string())],
                    names=["id", "n", "form", "prefix_chars", "middle_chars", "output"])

    kind = src.schema["id"].dataType.simpleString()
    return src.mapInArrow(run, f"id {kind}, n bigint, form string, prefix_chars bigint, middle_chars bigint, output string"
                          ).withColumnRenamed("id", id_col)


def restored(output: Column, form: Column) -> Column:
    """The text that an output was made from. Marks are found from the left: the text holds none itself."""
    first = F.when(form == "psm", F.instr(output, S.decode())).otherwise(F.instr(output, P.decode()))
    mid = F.instr(output, M.decode())
    lead, inner, tail = F.substr(output, F.lit(4), first - 4), F.substr(output, first + 3, mid - first - 3), F.substr(output, mid + 3)
    return (F.when(form == "plain", output).when(form == "psm", F.concat(lead, tail, inner)).otherwise(F.concat(inner, tail, lead)))
