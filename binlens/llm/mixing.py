"""Mixing sources to target weights, in DataFrame and SQL functions only.

1. Sources in code point order (null last) weigh 5, 2, 1, repeating. Targets share the corpus's words by
   weight; a target stops at ``max_epochs`` times its source's size and the excess is reshared.
2. The documents of a source, in id order, are one token stream, cut into blocks of ``block`` words
   (the last may be shorter).
3. A source gets as many block slots as its target asks for. Each slot draws its output shard by hash;
   given the source's total, its counts over equal shards are thus one multinomial draw.
4. Slot ``r`` of a source takes block ``perm(r mod blocks)`` of epoch ``r div blocks``, where ``perm`` is a
   pseudorandom permutation of the block indices, keyed by source and epoch (swap-or-not rounds).
5. Slots and blocks are joined by (source, index).

Positions in a stream come from windows over (source, range of 4096 ids) plus one offset per such bucket,
and slots are generated in runs of ``RUN``, so a hot source is spread over many tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from binlens.llm.common import materialise, shuffle_width

WEIGHTS = (5, 2, 1)
MAX_EPOCHS = 3
BLOCK = 32
BUCKET = 4096
RUN = 4096
ROUNDS = 12
P31 = 2147483647
OUTPUT_SHARDS = 24

WORD = r"[^\x20\x09-\x0D]+"


def _light(docs: DataFrame, id_col: str, text_col: str, source_col: str, carry: bool) -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(*([F.struct("*").alias("row")] if carry else []), F.col(id_col).alias("id"),
                       F.col(source_col).alias("source"),
                       F.regexp_count(text, F.lit(WORD)).cast("long").alias("size"),
                       F.crc32(text.cast("binary")).alias("crc"))


def _bucket(df: DataFrame) -> DataFrame:
    numeric = F.col("id").try_cast("long")
    return df.withColumn("bucket", F.coalesce(F.floor(numeric / F.lit(BUCKET)), -1 - F.pmod("crc", F.lit(BUCKET))))


def source_targets(sized: DataFrame, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """(source, rank, source_size, target) from rows of (source, size)."""
    by_name = Window.orderBy(F.col("source").asc_nulls_last())       # one row per source from here on
    by_ratio = Window.orderBy("ratio", "rank").rowsBetween(Window.unboundedPreceding, -1)
    all_rows = Window.partitionBy()
    s = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    s = s.withColumn("rank", F.row_number().over(by_name) - 1)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in WEIGHTS]), (F.col("rank") % len(WEIGHTS) + 1).cast("int"))
    s = s.withColumn("weight", weight).withColumn("most", F.lit(float(max_epochs)) * F.col("source_size"))
    s = s.withColumn("ratio", F.col("most") / F.col("weight"))
    level = ((F.sum("source_size").over(all_rows) - F.coalesce(F.sum("most").over(by_ratio), F.lit(0.0)))
             / (F.sum("weight").over(all_rows) - F.coalesce(F.sum("weight").over(by_ratio), F.lit(0.0))))
    s = s.withColumn("level", level)
    # capping sources in order of their ratio: the first level that no uncapped source exceeds
    place = F.when(F.col("level") <= F.col("ratio"), F.row_number().over(Window.orderBy("ratio", "rank")))
    s = s.withColumn("place", place).withColumn("level", F.min_by("level", "place").over(all_rows))
    return s.select("source", "rank", "source_size",
                    F.least("most", F.coalesce("level", F.lit(0.0)) * F.col("weight")).alias("target"))


def _positions(rows: DataFrame, light: DataFrame, targets: DataFrame) -> DataFrame:
    """``rows`` with rank, source_size, target and ``start``: the row's first word in its source's stream."""
    sums = _bucket(light).groupBy("source", "bucket").agg(F.sum("size").alias("n"))
    before = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offs = sums.select("source", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    offs = offs.join(targets, offs["source"].eqNullSafe(targets["source"])).select(offs["source"].alias("s2"),
        F.col("bucket").alias("b2"), "offset", "rank", "source_size", "target")
    inside = (Window.partitionBy("source", "bucket").orderBy(F.col("id").asc_nulls_last(), "crc", "size")
              .rowsBetween(Window.unboundedPreceding, -1))
    local = _bucket(rows).withColumn("local", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    return (local.join(offs, F.col("source").eqNullSafe(F.col("s2")) & (F.col("bucket") == F.col("b2")))
            .withColumn("start", F.col("offset") + F.col("local")).drop("s2", "b2", "bucket", "offset", "local"))


def _keys():
    """Keys of the permutation rounds for a source (by rank) and an epoch: [(shift, salt), ...]."""
    seed = (F.col("rank").cast("long") * 7919 + F.col("epoch") * 104729 + 12345) % P31
    h = [seed]
    for _ in range(ROUNDS):
        h.append((h[-1] * 48271 + 11) % P31)
    return F.array(*[F.struct(((x * 69621 % P31) * P31 + x * 16807 % P31).alias("shift"), x.alias("salt")) for x in h[1:]])


def _permuted(x, keys, n):
    """Swap-or-not: each round maps x to (shift - x) mod n or leaves it, as a keyed bit of the larger says."""
    def step(acc, k):
        other = (k["shift"] % n - acc + n) % n
        high = F.greatest(acc, other)
        bit = ((((high % P31) * 48271 + k["salt"]) % P31 * 69621 + F.floor(high / F.lit(P31))) % P31)
        return F.when(F.floor(bit / F.lit(1024)) % 2 == 1, other).otherwise(acc)
    return F.aggregate(keys, x, step)


def block_slots(targets: DataFrame, block: int = BLOCK, output_shards: int = OUTPUT_SHARDS) -> DataFrame:
    """(rank, slot, epoch, index, out_shard): every slot of the mix and the block that fills it."""
    width = shuffle_width(targets.sparkSession)
    s = targets.where("source_size > 0").withColumn("blocks", F.ceil(F.col("source_size") / F.lit(block)))
    s = s.withColumn("slots", F.floor(F.col("target") * F.col("blocks") / F.col("source_size") + F.lit(0.5)))
    epochs = (s.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(MAX_EPOCHS - 1)))
                           ).withColumn("epoch", F.col("epoch").cast("long"))
              .withColumn("first", F.col("epoch") * F.col("blocks")).where("first < slots")
              .withColumn("here", F.least("blocks", F.col("slots") - F.col("first")))
              .withColumn("keys", _keys()))
    runs = (epochs.select("rank", "epoch", "first", "blocks", "here", "keys",
                          F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("here") - 1) / F.lit(RUN)))).alias("run"))
            .repartition(width, "rank", "epoch", "run"))
    last = F.least(F.col("here"), (F.col("run") + 1) * RUN) - 1
    slot = runs.withColumn("x", F.explode(F.sequence(F.col("run") * RUN, last)))
    return slot.select("rank", (F.col("first") + F.col("x")).alias("slot"), "epoch",
                       _permuted(F.col("x"), F.col("keys"), F.col("blocks")).alias("index"),
                       F.pmod(F.xxhash64(F.lit(29), "rank", "epoch", "x"), F.lit(output_shards)).cast("int").alias("out_shard"))


def _overlaps(placed: DataFrame, uses: DataFrame, block: int) -> DataFrame:
    """(rank, start, b, lo, hi, uses): the word range [lo, hi) of a document that lies in a used block."""
    rows = placed.where("size > 0").select("rank", "start", "size", F.explode(F.sequence(
        F.floor(F.col("start") / F.lit(block)), F.floor((F.col("start") + F.col("size") - 1) / F.lit(block)))).alias("b"))
    u = uses.select(F.col("rank").alias("r2"), F.col("index").alias("i2"), "uses")
    # the planner sees only the few targets behind the slots; without a hint it would broadcast them all
    rows = rows.join(u.hint("merge"), (F.col("rank") == F.col("r2")) & (F.col("b") == F.col("i2")))
    return rows.select("rank", "start", "b",
                       F.greatest(F.col("b") * block - F.col("start"), F.lit(0)).alias("lo"),
                       F.least((F.col("b") + 1) * block - F.col("start"), "size").alias("hi"), "uses")


def _prepared(docs, id_col, text_col, source_col, block, output_shards):
    light = materialise(_light(docs, id_col, text_col, source_col, carry=False), "mix-sizes")
    targets = materialise(source_targets(light), "mix-targets")
    uses = block_slots(targets, block, output_shards).groupBy("rank", "index").agg(F.count(F.lit(1)).alias("uses"))
    return light, targets, uses


def mix_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
               block: int = BLOCK, output_shards: int = OUTPUT_SHARDS) -> DataFrame:
    """(id, source, size, source_size, target, taken) for every row of ``docs``.

    Null texts and texts without words have size 0 and taken 0; a null source is a source of its own,
    last in order; null ids stand last in their stream; repeated rows are documents of their own. Extra
    columns are never read. Empty input: no rows. Without any words every target is 0.
    """
    light, targets, uses = _prepared(docs, id_col, text_col, source_col, block, output_shards)
    placed = _positions(light, light, targets)
    got = _overlaps(placed, uses, block).groupBy("rank", "start").agg(
        F.sum((F.col("hi") - F.col("lo")) * F.col("uses")).alias("got"))
    # rows of a source with words start at different positions
    key = F.when(F.col("size") > 0, F.col("start"))
    out = placed.join(got.select(F.col("rank").alias("r2"), F.col("start").alias("s2"), "got").hint("merge"),
                      (F.col("rank") == F.col("r2")) & (key == F.col("s2")), "left")
    return out.select("id", "source", "size", "source_size", "target",
                      F.coalesce("got", F.lit(0)).cast("long").alias("taken"))


def mix_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
                  chars_col: str = "n_chars", block: int = BLOCK, output_shards: int = OUTPUT_SHARDS) -> DataFrame:
    """The mix in the columns of ``docs``: up to ``MAX_EPOCHS`` rows per document, row ``e`` holding the
    words of its blocks that are used ``e`` times or more, joined by spaces (the whole words in order when
    all are). ``chars_col``, where present, becomes the new text's length. Documents of which the mix
    takes no word don't appear. Nulls, repeated rows and extra columns as in ``mix_counts``."""
    light, targets, uses = _prepared(docs, id_col, text_col, source_col, block, output_shards)
    parts = _overlaps(_positions(light, light, targets), uses, block).groupBy("rank", "start").agg(
        F.array_sort(F.collect_list(F.struct("b", "lo", "hi", "uses"))).alias("parts"))   # the blocks of one document
    placed = _positions(_light(docs, id_col, text_col, source_col, carry=True), light, targets).where("size > 0")
    rows = placed.join(parts.select(F.col("rank").alias("r2"), F.col("start").alias("s2"), "parts").hint("merge"),
                       (F.col("rank") == F.col("r2")) & (F.col("start") == F.col("s2")))
    most = F.array_max(F.transform("parts", lambda p: p["uses"]))
    # words are split below the explode, which keeps the split out of the function applied to each block
    rows = rows.select("row", "parts", most.alias("most"),
                       F.regexp_extract_all(F.col(f"row.{text_col}"), F.lit(f"({WORD})")).alias("words"))
    rows = rows.select("row", "parts", "words", F.explode(F.sequence(F.lit(1).cast("long"), F.col("most"))).alias("e"))
    taken = F.flatten(F.transform(F.filter("parts", lambda p: p["uses"] >= F.col("e")),
                                  lambda p: F.slice("words", (p["lo"] + 1).cast("int"), (p["hi"] - p["lo"]).cast("int"))))
    rows = rows.select("row", F.array_join(taken, " ").alias("new"))
    row = F.col("row").withField(text_col, F.col("new"))
    if chars_col in docs.columns:
        row = row.withField(chars_col, F.length("new").cast(docs.schema[chars_col].dataType))
    return rows.select(row.alias("row")).select("row.*")
