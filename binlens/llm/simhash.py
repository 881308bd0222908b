"""SimHash near-duplicate detection with pigeonhole blocks.

1. Each text becomes a 64-bit fingerprint: a bit is 1 where more than half of the XXH64 hashes (seed
   42) of its word shingles have it. Texts are read once; only (id, fingerprint) goes on.
2. Copies share a fingerprint, so all later work is on distinct fingerprints.
3. The 64 bits are cut into ``max_bits + 2`` blocks. Two fingerprints within ``max_bits`` bits differ in
   at most ``max_bits`` blocks, so they agree on at least two: they meet under one of the block pairs,
   each a join key of about ``2 * 64 / (max_bits + 2)`` bits.
4. Fingerprints of one key are joined and verified by Hamming distance. A key with more than
   ``block_limit`` members is not paired out: its members are split again by their one-bit neighbours
   (two fingerprints within two bits share one; all that share one are within two bits of each other),
   each linked to the smallest under the same neighbour. That is linear in the members and exact.
5. Links are closed into components (``components.py``).
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from binlens.llm.common import materialise, utf8, words_of
from binlens.llm.components import connected_components

#: Hashes turned into bits at a time (bounds memory on very long texts).
CHUNK = 1 << 16


def shingle_hashes(text: bytes | None, shingle: int) -> list[int]:
    words = words_of(text)
    if not words:
        return []
    buf = b" ".join(words)
    if len(words) <= shingle:
        return [xxhash.xxh64_intdigest(buf, 42)]
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate(([0], ends[:-1]))[:len(words) - shingle + 1].tolist()
    stops = (ends[shingle - 1:] - 1).tolist()
    h = xxhash.xxh64_intdigest
    return [h(buf[i:j], 42) for i, j in zip(starts, stops)]


def fingerprint(text: bytes | None, shingle: int = 3) -> int:
    """The 64-bit fingerprint as an unsigned integer; a text without words: 0."""
    hashes = shingle_hashes(text, shingle)
    if not hashes:
        return 0
    counts = np.zeros(64, np.int64)
    for lo in range(0, len(hashes), CHUNK):
        h = np.array(hashes[lo:lo + CHUNK], np.uint64)
        counts += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view(np.uint64)[0])


def text_key(text_col: str):
    """A hash of the text (null as empty) that tells rows of one id apart."""
    return F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3,
                 keyed: bool = False) -> DataFrame:
    """(id_col, fp long) for every row of ``docs``; ``keyed``: and ``__key``, the text's hash."""
    key = [text_key(text_col).alias("__key")] if keyed else []
    src = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), *key)

    def run(batches):
        for b in batches:
            fps = np.array([fingerprint(t, shingle) for t in utf8(b, "text")], np.uint64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps.view(np.int64)), *b.columns[2:]],
                                             names=["id", "fp", *b.schema.names[2:]])

    kind = src.schema["id"].dataType.simpleString()
    schema = f"id {kind}, fp long" + (", __key long" if keyed else "")
    return src.mapInArrow(run, schema).withColumnRenamed("id", id_col)


def _blocks(max_bits: int) -> list[tuple[int, int]]:
    n = max_bits + 2
    cuts = [64 * i // n for i in range(n + 1)]
    return [(lo, hi - lo) for lo, hi in zip(cuts, cuts[1:])]


def close_pairs(fps: DataFrame, max_bits: int = 2, block_limit: int = 64) -> DataFrame:
    """Links (a, b) over distinct fingerprints ``fp`` whose components equal those of all pairs within
    ``max_bits`` bits. Blocks beyond ``block_limit`` members are split by one-bit neighbours, which is
    exact for ``max_bits`` of 1 or 2; other distances pair their blocks out."""
    blocks = _blocks(max_bits)
    part = [F.shiftrightunsigned("fp", lo).bitwiseAND(F.lit((1 << width) - 1)) for lo, width in blocks]
    keys = [F.struct(F.lit(t).alias("t"), F.shiftleft(part[i], blocks[j][1]).bitwiseOR(part[j]).alias("key"))
            for t, (i, j) in enumerate(combinations(range(len(blocks)), 2))]
    rows = fps.select("fp", F.explode(F.array(*keys)).alias("k")).select("k.t", "k.key", "fp")
    sizes = rows.groupBy("t", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    member = materialise(rows.join(sizes, ["t", "key"]), "simhash-blocks")
    splits = max_bits in (1, 2)
    paired = member.where(F.col("n") <= block_limit) if splits else member
    left = paired.select("t", "key", F.col("fp").alias("a"))
    right = paired.select("t", "key", F.col("fp").alias("b"))
    near = (left.join(right, ["t", "key"])
            .where((F.col("a") < F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= max_bits))
            .select("a", "b"))
    if not splits:
        return near
    flips = [F.lit(1 << i if i < 63 else -(1 << 63)).cast("long") for i in range(64)]
    around = F.array(F.col("fp"), *[F.col("fp").bitwiseXOR(m) for m in flips])
    hot = (member.where(F.col("n") > block_limit).select("fp").distinct()
           .select(F.col("fp").alias("b"), F.explode(around).alias("near")))
    # at most 65 fingerprints lie within one bit of a neighbour, so these windows are small
    hot = hot.select(F.min("b").over(Window.partitionBy("near")).alias("a"), "b").where("a < b")
    hot = hot.where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= max_bits)
    return near.union(hot)


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3,
                       max_bits: int = 2, block_limit: int = 64) -> DataFrame:
    """(id_col, fp long, root long, component_id) for every row of ``docs``.

    ``root`` names the component (its smallest fingerprint as a signed long), ``component_id`` is the
    smallest id reachable over links of at most ``max_bits`` bits, itself included. Null and wordless
    texts: fingerprint 0, linked like any other. Null ids take part; they never are the smallest unless
    a component has no other (then component_id is null). Repeated rows stay, one row each. Empty
    input: no rows. Columns other than the two named are ignored, whatever their names.
    """
    fps = materialise(fingerprints(docs, id_col, text_col, shingle), "simhash-fp")
    return _with_components(fps, id_col, max_bits, block_limit)


def _with_components(fps: DataFrame, id_col: str, max_bits: int, block_limit: int) -> DataFrame:
    """``fps`` (id_col, fp and other columns; written) with the root and component_id of each row."""
    first = fps.groupBy("fp").agg(F.min(id_col).alias("first_id"))
    links = close_pairs(first.select("fp"), max_bits, block_limit)
    roots = connected_components(links)
    known = (first.join(roots, first["fp"] == roots["node"], "left")
             .select("fp", "first_id", F.coalesce("root", "fp").alias("root")))
    least = known.groupBy("root").agg(F.min("first_id").alias("component_id"))
    comp = known.select("fp", "root").join(least, "root")
    return fps.join(comp, "fp").select(*fps.columns, "root", "component_id")


def hex_fingerprint(fp):
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3,
                     max_bits: int = 2, block_limit: int = 64) -> DataFrame:
    """``docs`` with one row of each component: the one with the smallest id (of repeated rows with
    that id, the smallest text). A component whose ids are all null keeps one of its rows, the one with
    the smallest text. Rows are told apart by id and text, so a null or repeated id that lies in several
    components keeps a row of its own in each."""
    fps = materialise(fingerprints(docs, id_col, text_col, shingle, keyed=True), "simhash-fp")
    chosen = (_with_components(fps, id_col, max_bits, block_limit)
              .where(F.col(id_col).eqNullSafe(F.col("component_id")))
              .select(F.col(id_col).alias("__id"), F.col("__key"), F.col("root").alias("__root")).distinct())
    rows = docs.select(F.struct("*").alias("__row"), F.col(id_col).alias("__rid"), F.col(text_col).alias("__text"),
                       text_key(text_col).alias("__rkey"))
    kept = rows.join(chosen, rows["__rid"].eqNullSafe(chosen["__id"]) & (rows["__rkey"] == chosen["__key"]))
    one = Window.partitionBy("__root").orderBy(F.col("__text").asc_nulls_last())
    kept = kept.withColumn("__n", F.row_number().over(one)).where("__n = 1")
    return kept.select("__row.*")
