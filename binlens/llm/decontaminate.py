"""Benchmark decontamination by q-gram lemma filtering and banded alignment.

Texts and items are normalised alike (lower case, runs of white space to one space). An item of length L
counts as contained when a region of the text aligns with all of it within ``e = floor(budget * L)``
edits. By the q-gram lemma such a region shares at least ``L + 1 - q - q * e`` q-grams with the item, and
they all lie on diagonals (text position minus item position) at most ``e`` apart. Only whole items count:
a text that quotes a part of an item (a cut of it more than ``e`` code points short, say) does not contain it.

Per text: every q-gram is hashed (one rolling pass over an array of code points) and looked up in the
items' q-grams; matches are counted in diagonal bands ``2e + 1`` wide that overlap by half or more, so any
``e + 1`` neighbouring diagonals lie inside one band; bands that reach the bound go to a banded
semi-global alignment, which decides. Nothing is shuffled: the items, whose size is checked, go to the
workers, and texts stream through. A benchmark beyond ``MAX_ITEM_CHARS`` is cut into parts of that size,
each one pass.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from binlens.llm.common import text_runs, utf8

Q = 8
BUDGET = 0.08
#: Code points of items sent to the workers at a time.
MAX_ITEM_CHARS = 8_000_000
#: Items shorter than this (normalised) are matched exactly, without edits.
SHORT = 40
TABLE_BITS = 22
RUN_BYTES = 4_000_000
_MULT = np.uint64(0x9E3779B97F4A7C15)
_BASE = np.uint64(0x100000001B3)


def normalised(text: bytes | None) -> str:
    """Lower case with white-space runs (of any script) as one space, ends trimmed; null: empty."""
    return " ".join(text.decode("utf-8", "replace").lower().split()) if text else ""


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def gram_hashes(points: np.ndarray, q: int = Q) -> np.ndarray:
    """64-bit polynomial hash of every window of ``q`` code points (none: shorter than q)."""
    if len(points) < q:
        return np.empty(0, np.uint64)
    n = len(points) - q + 1
    if q == 8:      # by doubling
        h = points.astype(np.uint64) + np.uint64(1)
        base = _BASE
        for w in (1, 2, 4):
            h = h[:-w] * base + h[w:]
            with np.errstate(over="ignore"):
                base = base * base
        return h
    h = np.zeros(n, np.uint64)
    for i in range(q):
        h = h * _BASE + (points[i:n + i].astype(np.uint64) + np.uint64(1))
    return h


def _slot(h: np.ndarray) -> np.ndarray:
    return ((h * _MULT) >> np.uint64(64 - TABLE_BITS)).astype(np.int64)


def edit_budget(length: int, budget: float) -> int:
    return int(budget * length) if length >= SHORT else 0


class Items:
    """The items' q-grams: a hit table over hash slots, and postings sorted by hash."""

    def __init__(self, rows: list[tuple], q: int = Q, budget: float = BUDGET):
        self.q, self.budget = q, budget
        self.ids, self.points = [], []
        for item_id, text in rows:
            p = code_points(normalised(text.encode() if isinstance(text, str) else text))
            if len(p):
                self.ids.append(item_id)
                self.points.append(p)
        n = len(self.ids)
        self.length = np.array([len(p) for p in self.points], np.int64)
        self.edits = np.array([edit_budget(len(p), budget) for p in self.points], np.int64)
        # as few edits as leave a positive bound: the lemma must bite
        self.edits = np.minimum(self.edits, np.maximum((self.length - q) // q, 0))
        self.bound = np.maximum(self.length + 1 - q - q * self.edits, 1)
        grams = [gram_hashes(p, q) for p in self.points]
        h = np.concatenate(grams) if n else np.empty(0, np.uint64)
        item = np.repeat(np.arange(n), [len(g) for g in grams])
        pos = np.concatenate([np.arange(len(g)) for g in grams]) if n else np.empty(0, np.int64)
        order = np.argsort(h, kind="stable")
        self.hash, self.item, self.pos = h[order], item[order], pos[order]
        self.table = np.zeros(1 << TABLE_BITS, bool)
        self.table[_slot(self.hash)] = True
        self.tiny = [i for i in range(n) if self.length[i] < q]

    def hits(self, points: np.ndarray):
        """(text position, item, item position) of all shared q-grams."""
        h = gram_hashes(points, self.q)
        at = np.flatnonzero(self.table[_slot(h)])
        h = h[at]
        lo, hi = np.searchsorted(self.hash, h, "left"), np.searchsorted(self.hash, h, "right")
        many = hi - lo
        at, lo, many = at[many > 0], lo[many > 0], many[many > 0]
        which = np.repeat(lo - np.concatenate(([0], np.cumsum(many)[:-1])), many) + np.arange(many.sum())
        return np.repeat(at, many), self.item[which], self.pos[which]

    def regions(self, points: np.ndarray, starts: np.ndarray):
        """(document, item, first text position, last) of the bands that reach the bound. ``starts`` are
        the documents' first positions in ``points``; a document's end is padded with a separator."""
        at, item, pos = self.hits(points)
        if not len(at):
            return []
        doc = np.searchsorted(starts, at, "right") - 1
        width = self.edits[item] + 1
        diag = at - pos + int(self.length.max())    # not negative
        out = set()
        for shift in (0, 1):    # bands of 2 * width diagonals, every width
            band = (diag // width + shift) // 2
            key = np.stack([doc, item, band])
            order = np.lexsort((at, band, item, doc))
            k = key[:, order]
            new = np.concatenate(([True], (k[:, 1:] != k[:, :-1]).any(0)))
            first = np.flatnonzero(new)
            count = np.diff(np.append(first, len(order)))
            bound = self.bound[item[order][first]]
            for f, c in zip(first[count >= bound], count[count >= bound]):
                span = at[order[f:f + c]]
                out.add((int(k[0, f]), int(k[1, f]), int(span[0]), int(span[-1])))
        return sorted(out)

    def align(self, text: np.ndarray, item: int):
        """(edits, start, stop) of the best alignment of the whole item inside ``text``, or None beyond its
        budget. ``text`` is the region widened by the budget; only diagonals within reach are kept."""
        p, e = self.points[item], int(self.edits[item])
        n, m = len(text), len(p)
        if n < m - e:       # more deletions than the budget
            return None
        big = m + n + 1
        # Sellers' recurrence, one item symbol at a time over all text positions of the region
        cost, start = np.zeros(n + 1, np.int64), np.arange(n + 1)
        for j in range(m):
            keep_c, keep_s = cost, start
            cost = np.full(n + 1, big)
            start = np.zeros(n + 1, np.int64)
            lo, hi = max(0, j - e), min(n, n - m + j + 1 + e)     # the band of reachable text positions
            diag = keep_c[lo:hi] + (text[lo:hi] != p[j])
            down = keep_c[lo + 1:hi + 1] + 1
            better = diag <= down
            c = np.where(better, diag, down)
            s = np.where(better, keep_s[lo:hi], keep_s[lo + 1:hi + 1])
            # insertions: min over earlier positions of cost + distance, as a running minimum
            ramp = np.arange(hi - lo)
            if lo == 0:
                c = np.concatenate(([keep_c[0] + 1], c))
                s = np.concatenate(([keep_s[0]], s))
                ramp = np.arange(hi + 1)
            low = np.minimum.accumulate(c - ramp)
            take = np.maximum.accumulate(np.where(c - ramp == low, np.arange(len(c)), 0))
            first = 0 if lo == 0 else lo + 1
            cost[first:first + len(c)] = low + ramp
            start[first:first + len(c)] = s[take]
        stop = int(np.argmin(cost))
        return (int(cost[stop]), int(start[stop]), stop) if cost[stop] <= e else None

    def matches(self, texts: list[str]):
        """(index, item id, start, stop, edits) of the best region of every contained item in each text;
        positions are code points of the normalised text."""
        points = [code_points(t) for t in texts]
        starts = np.concatenate(([0], np.cumsum([len(p) + self.q for p in points]))).astype(np.int64)
        gap = np.full(self.q, 0x10FFFF, np.uint32)      # never a character of a text
        joined = np.concatenate([x for p in points for x in (p, gap)]) if points else np.empty(0, np.uint32)
        best = {}
        for doc, item, a, b in self.regions(joined, starts[:-1]):
            e, m, base = int(self.edits[item]), int(self.length[item]), int(starts[doc])
            reach = max(0, m - (b + self.q - a))
            lo = max(base, a - reach - e)
            hi = min(base + len(points[doc]), b + self.q + reach + e)
            found = self.align(joined[lo:hi], item)
            if found and found < best.get((doc, item), (e + 1,)):
                best[doc, item] = (found[0], lo - base + found[1], lo - base + found[2])
        for item in self.tiny:
            needle = self.points[item].tobytes().decode("utf-32-le")
            for doc, t in enumerate(texts):
                at = t.find(needle)
                if at >= 0:
                    best[doc, item] = (0, at, at + len(needle))
        return [(doc, self.ids[item], s, t, c) for (doc, item), (c, s, t) in sorted(best.items())]


def item_parts(benchmark: DataFrame, id_col: str, text_col: str, max_chars: int = MAX_ITEM_CHARS):
    """The benchmark's rows in lists of at most ``max_chars`` code points, read one after the other."""
    part, size = [], 0
    rows = benchmark.select(id_col, text_col).where(F.length(F.trim(text_col)) > 0)
    for r in rows.toLocalIterator():
        if part and size + len(r[1]) > max_chars:
            yield part
            part, size = [], 0
        part.append((r[0], r[1]))
        size += len(r[1])
    if part:
        yield part


def find_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
               item_col: str = "item_id", item_text_col: str = "text", q: int = Q, budget: float = BUDGET) -> DataFrame:
    """(id_col, key, item_col, start, stop, edits): one row per document row and contained item.

    ``start`` and ``stop`` bound the best region, in code points of the normalised text; ``key`` is a hash
    of the text. Null, empty and blank texts or items never match; null ids are kept; repeated rows
    match one by one; other columns are not read. Items quoted in part only do not match. An empty side gives
    no rows.
    """
    spark = docs.sparkSession
    src = docs.select(F.col(id_col).alias("id"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("key"),
                      F.col(text_col).alias("text"))
    kinds = src.schema["id"].dataType.simpleString(), benchmark.schema[item_col].dataType.simpleString()
    schema = f"id {kinds[0]}, key long, item {kinds[1]}, start int, stop int, edits int"
    out = spark.createDataFrame([], schema)
    for part in item_parts(benchmark, item_col, item_text_col):
        sent = spark.sparkContext.broadcast(part)       # at most MAX_ITEM_CHARS, or one item

        def run(batches, sent=sent):
            items = Items(sent.value, q, budget)
            for b in batches:
                raw = utf8(b, "text")
                for lo, hi in text_runs(raw, RUN_BYTES):
                    found = items.matches([normalised(t) for t in raw[lo:hi]])
                    if found:
                        doc, item, start, stop, edits = zip(*found)
                        rows = pa.array([lo + d for d in doc])
                        yield pa.RecordBatch.from_arrays(
                            [b.column(0).take(rows), b.column(1).take(rows), pa.array(item), pa.array(start, pa.int32()),
                             pa.array(stop, pa.int32()), pa.array(edits, pa.int32())],
                            names=["id", "key", "item", "start", "stop", "edits"])

        out = out.unionAll(src.mapInArrow(run, schema))
    return out.select(F.col("id").alias(id_col), "key", F.col("item").alias(item_col), "start", "stop", "edits")


def drop_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` without the rows that contain a benchmark item; columns and repeated rows unchanged."""
    bad = find_leaks(docs, benchmark, id_col, text_col, **options).select(F.col(id_col).alias("__i"), F.col("key").alias("__k")).distinct()
    rows = docs.select(F.struct("*").alias("__row"), F.col(id_col).alias("__id"),
                       F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("__key"))
    on = F.col("__id").eqNullSafe(F.col("__i")) & (F.col("__key") == F.col("__k"))
    return rows.join(bad, on, "left_anti").select("__row.*")
