"""Registered queries of the training-data operators: name -> callable, and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from binlens.llm import (decontaminate, fill_middle, html_extract, lm_score, mixing, personal_data, quality, sharding, simhash,
                         suffix_dedup, toxicity, warc, whitening)
from binlens.sources.tables import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql.strip()
        return fn
    return deco


@query("op1_simhash")
def op1(spark, sf_dir):
    """3-word shingles, links at 2 or fewer differing bits."""
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    return (simhash.simhash_components(docs, shingle=3, max_bits=2)
            .select("doc_id", simhash.hex_fingerprint(F.col("fp")).alias("fingerprint"), "component_id"))


@query("op4_sharding")
def op4(spark, sf_dir):
    """24 shards whose row counts are at most one apart."""
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    return sharding.shard_rows(docs, carry=False).select(
        F.col("id").alias("doc_id"), "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"))


def _mix_sql() -> str:
    """The mix by plain ordered sums; one select per permutation round."""
    m = mixing
    rounds = "SELECT *, x AS y, (rank * 7919 + epoch * 104729 + 12345) % {p} AS h FROM slots"
    for _ in range(m.ROUNDS):
        rounds = (
            "SELECT * EXCLUDE (y, h, o), CASE WHEN ((((greatest(y, o) % {p}) * 48271 + h) % {p} * 69621 + greatest(y, o) // {p})"
            " % {p} // 1024) % 2 = 1 THEN o ELSE y END AS y, h FROM (SELECT *, (((h * 69621 % {p}) * {p} + h * 16807 % {p})"
            " % blocks - y + blocks) % blocks AS o FROM (SELECT * EXCLUDE (h), (h * 48271 + 11) % {p} AS h FROM (" + rounds + ")))")
    return f"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
r AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS rank FROM s),
w AS (SELECT *, [{', '.join(f'{float(x)}::DOUBLE' for x in m.WEIGHTS)}][rank % {len(m.WEIGHTS)} + 1] AS weight,
      {m.MAX_EPOCHS}::DOUBLE * source_size AS most FROM r),
v AS (SELECT *, row_number() OVER (ORDER BY most / weight, rank) AS place, (sum(source_size) OVER () - coalesce(sum(most) OVER before, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER before, 0))
      AS level FROM w WINDOW before AS (ORDER BY most / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (SELECT source, rank, source_size, least(most, coalesce(arg_min(level, place) FILTER (WHERE level <= most / weight) OVER (), 0) * weight)
      AS target FROM v),
b AS (SELECT *, (source_size + {m.BLOCK - 1}) // {m.BLOCK} AS blocks FROM t WHERE source_size > 0),
n AS (SELECT *, floor(target * blocks / source_size + 0.5)::BIGINT AS slots FROM b),
e AS (SELECT n.*, unnest(range({m.MAX_EPOCHS})) AS epoch FROM n),
slots AS (SELECT rank, epoch, blocks, unnest(range(least(blocks, slots - epoch * blocks))) AS x FROM e WHERE epoch * blocks < slots),
used AS (SELECT rank, y AS b, count(*) AS uses FROM ({rounds.replace('{p}', str(m.P31))}) GROUP BY rank, y),
p AS (SELECT d.*, t.rank, t.source_size, t.target,
      sum(size) OVER (PARTITION BY t.rank ORDER BY doc_id ROWS UNBOUNDED PRECEDING) - size AS start
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
x AS (SELECT doc_id, rank, start, size, unnest(range((start // {m.BLOCK})::BIGINT, ((start + size - 1) // {m.BLOCK} + 1)::BIGINT)) AS b
      FROM p WHERE size > 0),
g AS (SELECT doc_id, sum((least((x.b + 1) * {m.BLOCK}, start + size) - greatest(x.b * {m.BLOCK}, start)) * uses) AS got
      FROM x JOIN used ON x.rank = used.rank AND x.b = used.b GROUP BY doc_id)
SELECT p.doc_id, p.size, p.source_size, p.target, coalesce(g.got, 0)::BIGINT AS taken FROM p LEFT JOIN g USING (doc_id)"""


@query("op5_mixing", _mix_sql())
def op5(spark, sf_dir):
    """Weights 5, 2, 1 over sources in code point order, targets at most three times a source."""
    docs = table(spark, sf_dir, "documents", "doc_id", "text", "source")
    return mixing.mix_counts(docs).select(F.col("id").alias("doc_id"), "size", "source_size", "target", "taken")


@query("op6_quality")
def op6(spark, sf_dir):
    """50 words at least, at most half of them repeated, and no robust outlier in its language and source."""
    docs = table(spark, sf_dir, "documents", "doc_id", "text", "lang", "source")
    return quality.quality_verdicts(docs).select(F.col("id").alias("doc_id"), *quality.STATS, "base_failed",
                                                 "kept", "distance")


_B32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
#: Five hex digits are four base32 digits.
_DIGEST_SQL = ("array_to_string(list_transform(range(32), lambda i: substr('" + _B32 + "', ((('0x' || substr(h, (i // 4 * 5 + 1)::INT, 5))::BIGINT"
               " // [32768, 1024, 32, 1][i % 4 + 1]) % 32 + 1)::INT, 1)), '')")


@query("op9_warc", f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, strlen(html)::BIGINT AS payload_bytes, sha1(html) AS h FROM p),
f AS (SELECT page_id, payload_bytes, {_DIGEST_SQL} AS payload_digest, min(page_id) OVER (PARTITION BY h) AS o FROM d)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = o THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> o THEN o END AS refers_to FROM f""")
def op9(spark, sf_dir):
    """Archives of every page, read back; revisits from 0 bytes on."""
    pages = table(spark, sf_dir, "pages", "page_id", "url", "html")
    return warc.archive_index(pages, min_bytes=0).withColumnRenamed("id", "page_id")


@query("op10_decontamination")
def op10(spark, sf_dir):
    """Documents that contain a benchmark item within 8 edits per hundred characters."""
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    items = table(spark, sf_dir, "benchmark", "item_id", "text")
    return decontaminate.find_leaks(docs, items).drop("key")


@query("op3_toxicity")
def op3(spark, sf_dir):
    """Held out: crc32(doc_id) mod 5 is 0."""
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    labels = table(spark, sf_dir, "labels", "doc_id", "toxic")
    return toxicity.toxicity_scores(docs, labels)


@query("op7_lm_scoring")
def op7(spark, sf_dir):
    """Held out: crc32(doc_id) mod 7 is 2."""
    return lm_score.lm_scores(table(spark, sf_dir, "documents", "doc_id", "text"))


@query("op8_suffix_dedup")
def op8(spark, sf_dir):
    """Passages of 50 bytes and more that a document with a smaller id has too."""
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    return suffix_dedup.dedup_passages(docs, keep_text=False)


@query("op2_html_extraction")
def op2(spark, sf_dir):
    return html_extract.extract_pages(table(spark, sf_dir, "pages", "page_id", "url", "html"))


@query("op11_personal_data")
def op11(spark, sf_dir):
    """Base kinds counted and listed; ``spans`` also holds what the validators and the context confirm beyond them."""
    found = personal_data.find_personal(table(spark, sf_dir, "documents", "doc_id", "text"))
    spans = F.col("spans")
    return found.select("doc_id", *[personal_data.count_of(spans, k).alias(f"n_{k}") for k in ("email", "ip", "card", "phone")],
                        F.sha2(personal_data.listed(F.filter(spans, lambda s: s["base"])), 256).alias("base_sha256"),
                        personal_data.listed(spans).alias("spans"))


@query("op12_fill_middle", """
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, sha256('7:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
u AS (SELECT *, regexp_extract_all(text, '[^\n]*\n|[^\n]+') AS units, ('0x' || substr(h, 1, 8))::BIGINT AS h1, ('0x' || substr(h, 9, 8))::BIGINT AS h2,
      ('0x' || substr(h, 17, 8))::BIGINT AS h3, ('0x' || substr(h, 25, 8))::BIGINT AS h4 FROM d),
c AS (SELECT *, len(units)::BIGINT AS n, least(h1 % (len(units) + 1), h2 % (len(units) + 1)) AS x, greatest(h1 % (len(units) + 1), h2 % (len(units) + 1)) AS y,
      CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 100 THEN 'plain'
           WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM u),
t AS (SELECT *, array_to_string(units[1:x], '') AS pre, array_to_string(units[x + 1:y], '') AS mid, array_to_string(units[y + 1:], '') AS suf FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(pre)::BIGINT END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(mid)::BIGINT END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid
              ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256, sha256(text) AS restored_sha256 FROM t""")
def op12(spark, sf_dir):
    """Lines as units, every text cut, half of them with the suffix first."""
    out = fill_middle.fill_in_middle(table(spark, sf_dir, "documents", "doc_id", "text"))
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2(F.col("output").cast("binary"), 256).alias("output_sha256"),
                      F.sha2(fill_middle.restored(F.col("output"), F.col("form")).cast("binary"), 256).alias("restored_sha256"))


@query("op13_whitening")
def op13(spark, sf_dir):
    """Up to 16 components of the vectors on a grid of 1/64."""
    return whitening.whiten(table(spark, sf_dir, "embeddings", "vec_id", "embedding"))
