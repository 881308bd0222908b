"""Extraction queries (A2, A4, A6, A11-A14, B1-B23) over the stand-in corpus tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from binlens.functions.bytes import le_uint, starts_with_bytes
from binlens.functions.ranking import md5_key
from binlens.functions.text import (base_name, escape_linebreaks, label_from_path, strip_extension,
                                    year_from_bracketed_stamp, year_from_epoch_seconds)
from binlens.operators import graph as G
from binlens.operators import ngrams as NG
from binlens.operators import pe as PE
from binlens.operators.dedup import content_groups, dedup_exact
from binlens.plans import standins as si
from binlens.plans.registry import query
from binlens.sources.lookups import WORD_CATEGORIES, dictionary_frame
from binlens.sources.pages import page_links
from binlens.sources.tables import table

CATS = sorted(WORD_CATEGORIES)
DICT_VALUES = ", ".join(f"('{c}', '{t}')" for c in CATS for t in WORD_CATEGORIES[c])

SAMPLES = """
WITH samples AS (
  SELECT d.doc_id,
         '/corpus/' || CASE WHEN l.quality = 0 THEN 'malware' WHEN l.quality = 1 THEN 'benign' ELSE 'unlabelled' END
           || '/' || d.lang || '/' || d.source || '/' || cast(d.doc_id AS VARCHAR) || '.bin' AS path,
         d.text
  FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)
"""


@query("label_from_source", SAMPLES + """
SELECT doc_id, path, CASE WHEN contains(path, 'malware') THEN 1 WHEN contains(path, 'benign') THEN 0 END AS label,
       CASE WHEN contains(path, 'malware') OR contains(path, 'benign') THEN 'ok' ELSE 'no_label_folder' END AS status
FROM samples""")
def q_label_from_source(spark, sf):
    s = si.samples(spark, sf)
    lab = label_from_path(F.col("path"))
    return s.select("doc_id", "path", lab.alias("label"),
                    F.when(lab.isNull(), F.lit("no_label_folder")).otherwise(F.lit("ok")).alias("status"))


@query("name_from_path", SAMPLES + """
SELECT doc_id, regexp_extract(path, '([^/]+)$', 1) AS sample_name,
       regexp_replace(regexp_extract(path, '([^/]+)$', 1), '\\.[^.]*$', '') AS stem FROM samples""")
def q_name_from_path(spark, sf):
    s = si.samples(spark, sf)
    n = base_name(F.col("path"))
    return s.select("doc_id", n.alias("sample_name"), strip_extension(n).alias("stem"))


@query("dedup_exact", SAMPLES + """
SELECT sha256(text) AS sample_id, cast(strlen(text) AS BIGINT) AS length, min(path) AS keep_path, count(*) AS n_copies
FROM samples GROUP BY ALL""")
def q_dedup_exact(spark, sf):
    return content_groups(si.samples(spark, sf))


@query("dedup_exact_rows", SAMPLES + """
SELECT sha256(text) AS sample_id, cast(strlen(text) AS BIGINT) AS length, min(path) AS path, arg_min(doc_id, path) AS doc_id,
       any_value(text) AS text, count(*) AS n_copies FROM samples GROUP BY sha256(text), strlen(text)""")
def q_dedup_exact_rows(spark, sf):
    kept = dedup_exact(si.samples(spark, sf))
    return kept.withColumn("text", F.decode("content", "UTF-8")).drop("content")


@query("duplicate_groups", SAMPLES + """
SELECT sha256(text) AS sample_id, cast(strlen(text) AS BIGINT) AS length, min(path) AS keep_path, count(*) AS n_copies
FROM samples GROUP BY ALL HAVING count(*) > 1""")
def q_duplicate_groups(spark, sf):
    return content_groups(si.samples(spark, sf)).filter(F.col("n_copies") > 1)


def _le_sql(h, off, w, kind="BIGINT"):
    pairs = " || ".join(f"substring({h}, {2 * (off + i) + 1}, 2)" for i in reversed(range(w)))
    return f"CASE WHEN strlen({h}) >= {2 * (off + w)} THEN cast(('0x' || {pairs})::UBIGINT AS {kind}) END"


@query("le_field_decode", SAMPLES + f"""
, hx AS (SELECT doc_id, hex(encode(text)) AS h FROM samples)
SELECT doc_id, substring(h, 1, 4) = '4D5A' AS magic_ok,
       {_le_sql('h', 0, 2)} AS u16_at_0, {_le_sql('h', 2, 4)} AS u32_at_2,
       {_le_sql('h', 60, 4)} AS u32_at_60, {_le_sql('h', 8, 8, 'DECIMAL(20,0)')} AS u64_at_8,
       year(to_timestamp({_le_sql('h', 4, 4)})) AS year_at_4
FROM hx""")
def q_le_field_decode(spark, sf):
    c = F.col("content")
    return si.samples(spark, sf).select(
        "doc_id", starts_with_bytes(c, 0, "4D5A").alias("magic_ok"), le_uint(c, 0, 2).alias("u16_at_0"),
        le_uint(c, 2, 4).alias("u32_at_2"), le_uint(c, 60, 4).alias("u32_at_60"), le_uint(c, 8, 8).alias("u64_at_8"),
        year_from_epoch_seconds(le_uint(c, 4, 4)).alias("year_at_4"))


@query("compile_year", """
SELECT o_orderkey,
       year(strptime(regexp_replace(regexp_extract(strftime(o_orderdate, '[%a %b %d %H:%M:%S %Y UTC]'), '\\[(.*?)\\]', 1),
                                    '^[A-Za-z]{3} ', ''), '%b %d %H:%M:%S %Y UTC')) AS year_from_text,
       year(to_timestamp(epoch(o_orderdate))) AS year_from_epoch
FROM orders""")
def q_compile_year(spark, sf):
    o = table(spark, sf, "orders", "o_orderkey", "o_orderdate")
    stamp = F.concat(F.lit("["), F.date_format(F.col("o_orderdate"), "EEE MMM dd HH:mm:ss yyyy"), F.lit(" UTC]"))
    secs = F.unix_timestamp(F.col("o_orderdate").cast("timestamp"))
    return o.select("o_orderkey", year_from_bracketed_stamp(stamp).alias("year_from_text"),
                    year_from_epoch_seconds(secs).alias("year_from_epoch"))


@query("compile_year_histogram", """
SELECT year(o_orderdate) AS year, count(*) AS n FROM orders WHERE year(o_orderdate) <= 2000 GROUP BY ALL""")
def q_year_hist(spark, sf):
    o = table(spark, sf, "orders", "o_orderdate")  # column subset read
    return (o.select(F.year("o_orderdate").alias("year")).filter(F.col("year") <= 2000)
            .groupBy("year").agg(F.count(F.lit(1)).alias("n")))


LINE_FIELDS = """
, lf AS (
  SELECT l_orderkey, l_linenumber AS source_rank, l_linenumber - 1 AS ordinal, 'returnflag' AS field, l_returnflag AS value FROM lineitem
  UNION ALL SELECT l_orderkey, l_linenumber, l_linenumber - 1, 'linestatus', l_linestatus FROM lineitem)
"""


def _line_fields(spark, sf):
    li = table(spark, sf, "lineitem", "l_orderkey", "l_linenumber", "l_returnflag", "l_linestatus")
    arr = F.array(F.struct(F.lit("returnflag").alias("field"), F.col("l_returnflag").alias("value")),
                  F.struct(F.lit("linestatus").alias("field"), F.col("l_linestatus").alias("value")))
    return li.select(F.col("l_orderkey").alias("sample_id"), F.col("l_linenumber").alias("source_rank"),
                     (F.col("l_linenumber") - 1).alias("ordinal"), F.inline(arr))


@query("merge_last_wins", "WITH x AS (SELECT 1)" + LINE_FIELDS + """
SELECT l_orderkey AS sample_id, field, max(value) AS value
FROM (SELECT *, max(source_rank) OVER (PARTITION BY l_orderkey, field) AS top FROM lf) WHERE source_rank = top
GROUP BY ALL""")
def q_merge_last_wins(spark, sf):
    return PE.merge_last_wins(_line_fields(spark, sf).drop("ordinal"))


def _qty_sections(spark, sf):
    li = table(spark, sf, "lineitem", "l_orderkey", "l_linenumber", "l_quantity", "l_discount")
    arr = F.array(F.struct(F.lit("quantity").alias("field"), F.col("l_quantity").cast("string").alias("value")),
                  F.struct(F.lit("discount").alias("field"), F.col("l_discount").cast("string").alias("value")))
    return li.select(F.col("l_orderkey").alias("sample_id"), (F.col("l_linenumber") - 1).cast("int").alias("ordinal"),
                     F.inline(arr))


@query("repeated_group_flatten", """
SELECT l_orderkey AS sample_id, 5 AS source_rank, 'quantity' || cast(l_linenumber - 1 AS VARCHAR) AS field, l_quantity AS value FROM lineitem
UNION ALL SELECT l_orderkey, 5, 'discount' || cast(l_linenumber - 1 AS VARCHAR), l_discount FROM lineitem""")
def q_flatten(spark, sf):
    f = PE.flatten_sections(_qty_sections(spark, sf))
    return f.withColumn("value", F.col("value").cast("double"))


PIVOT_FIELDS = [f"{f}{i}" for f in ("quantity", "discount") for i in range(7)]


@query("ragged_pivot", "SELECT l_orderkey AS sample_id, " + ", ".join(
    f"coalesce(max(CASE WHEN l_linenumber - 1 = {i} THEN {col} END), 0.0e0) AS {f}{i}"
    for f, col in (("quantity", "l_quantity"), ("discount", "l_discount")) for i in range(7))
    + " FROM lineitem GROUP BY l_orderkey")
def q_ragged_pivot(spark, sf):
    long_df = PE.flatten_sections(_qty_sections(spark, sf)).withColumn("value", F.col("value").cast("double"))
    return PE.to_wide(long_df, PIVOT_FIELDS, fill=0.0)


@query("escape_linebreaks", """
SELECT doc_id, cast(length(replace(text, chr(13) || chr(10), '\\r\\n')) AS BIGINT) AS n_chars_escaped,
       md5(replace(text, chr(13) || chr(10), '\\r\\n')) AS text_md5 FROM documents""")
def q_escape(spark, sf):
    d = table(spark, sf, "documents", "doc_id", "text")
    e = escape_linebreaks(F.col("text"))
    return d.select("doc_id", F.length(e).cast("bigint").alias("n_chars_escaped"), F.md5(e).alias("text_md5"))


NGRAM_SQL = """
WITH hx AS (SELECT doc_id, hex(encode(text)) AS h FROM documents),
g AS (SELECT doc_id, substring(h, 2 * i - 1, 4) AS gram FROM hx, range(1, cast(strlen(h) / 2 AS BIGINT)) r(i)),
cnt AS (SELECT doc_id AS sample_id, gram, count(*) AS n FROM g GROUP BY ALL)
"""


def _ngram_counts(spark, sf):
    d = table(spark, sf, "documents", "doc_id", "text")
    s = d.select(F.col("doc_id").alias("sample_id"), F.encode("text", "UTF-8").alias("content"))
    return NG.ngram_counts(s, "sample_id", "content", 2)


@query("byte_ngram_counts", NGRAM_SQL + "SELECT sample_id, gram, n FROM cnt")
def q_ngram_counts(spark, sf):
    return _ngram_counts(spark, sf)


@query("byte_ngram_vocab", NGRAM_SQL + """
, dfq AS (SELECT gram, count(DISTINCT sample_id) AS df FROM cnt GROUP BY gram)
SELECT gram, df, rank FROM (SELECT gram, df, row_number() OVER (ORDER BY df DESC, gram) AS rank FROM dfq) WHERE rank <= 100""")
def q_ngram_vocab(spark, sf):
    return NG.ngram_vocabulary(_ngram_counts(spark, sf), 100)


LINES = f"""
WITH lines AS (
  SELECT doc_id AS binary_id, cast(generate_subscripts(string_split(text, chr(10)), 1) - 1 AS INTEGER) AS node_idx,
         unnest(string_split(text, chr(10))) AS line FROM documents),
toks AS (SELECT binary_id, node_idx, unnest(regexp_extract_all(lower(line), '[a-z]+')) AS opcode FROM lines),
dict AS (SELECT DISTINCT * FROM (VALUES {DICT_VALUES}) t(category, opcode)),
hits AS (SELECT t.binary_id, t.node_idx, d.category FROM toks t JOIN dict d ON t.opcode = d.opcode),
cc AS (SELECT binary_id, node_idx, {", ".join(f"cast(count(*) FILTER (WHERE category = '{c}') AS BIGINT) AS {c}" for c in CATS)}
       FROM hits GROUP BY binary_id, node_idx)
"""


def _tokens(spark, sf):
    return G.mnemonic_tokens(si.instructions(spark, sf))


def _cat_counts(spark, sf):
    return G.category_counts(_tokens(spark, sf), dictionary_frame(spark, WORD_CATEGORIES), CATS)


@query("opcode_tokens", LINES + "SELECT opcode, count(*) AS n FROM toks GROUP BY opcode")
def q_opcode_tokens(spark, sf):
    return _tokens(spark, sf).groupBy("opcode").agg(F.count(F.lit(1)).alias("n"))


@query("opcode_category_counts", LINES + "SELECT * FROM cc")
def q_opcode_category_counts(spark, sf):
    return _cat_counts(spark, sf)


@query("unknown_opcodes", LINES + """
SELECT opcode, count(*) AS n FROM toks WHERE opcode NOT IN (SELECT opcode FROM dict) GROUP BY opcode""")
def q_unknown_opcodes(spark, sf):
    return G.unknown_opcodes(_tokens(spark, sf), dictionary_frame(spark, WORD_CATEGORIES))


@query("block_features", LINES + f"""
SELECT l.binary_id, l.node_idx, cast(strlen(l.line) AS INTEGER) AS size,
       {", ".join(f"coalesce(cc.{c}, 0) AS {c}" for c in CATS)}
FROM lines l LEFT JOIN cc ON l.binary_id = cc.binary_id AND l.node_idx = cc.node_idx""")
def q_block_features(spark, sf):
    return G.block_features(si.blocks(spark, sf), _cat_counts(spark, sf), CATS)


@query("graph_block_totals", LINES + f"""
, bf AS (SELECT l.binary_id, strlen(l.line) AS size, {", ".join(f"coalesce(cc.{c}, 0) AS {c}" for c in CATS)}
         FROM lines l LEFT JOIN cc ON l.binary_id = cc.binary_id AND l.node_idx = cc.node_idx),
g AS (SELECT binary_id, count(*) AS n_blocks, round(avg(size), 6) AS mean_block_size, cast(max(size) AS INTEGER) AS max_block_size,
             {", ".join(f"cast(sum({c}) AS BIGINT) AS total_{c}" for c in CATS)} FROM bf GROUP BY binary_id)
SELECT g.*, lb.quality AS label FROM g LEFT JOIN labels lb ON g.binary_id = lb.doc_id""")
def q_graph_block_totals(spark, sf):
    """B22 + B23: block sizes and category totals of each graph, with its class."""
    blocks = G.block_features(si.blocks(spark, sf), _cat_counts(spark, sf), CATS)
    labels = table(spark, sf, "labels", F.col("doc_id").alias("binary_id"), F.col("quality").cast("int").alias("label"))
    return G.block_totals(blocks, CATS, labels).withColumn("mean_block_size", F.round("mean_block_size", 6))


# ---- event graphs: binary = user, node = event type, edge = next event by (ts, event_id)

EDGES = """
WITH ev AS (SELECT user_id AS binary_id, event_type AS src,
                   lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS dst FROM events),
edges AS (SELECT binary_id, src, dst FROM ev WHERE dst IS NOT NULL),
nodes AS (SELECT binary_id, node, cast(row_number() OVER (PARTITION BY binary_id ORDER BY node) - 1 AS INTEGER) AS node_idx
          FROM (SELECT DISTINCT binary_id, src AS node FROM edges UNION SELECT binary_id, dst FROM edges)),
gate AS (SELECT n.binary_id, n.n_nodes, cast(coalesce(e.n_edges, 0) AS BIGINT) AS n_edges,
                cast(n.n_nodes * n.n_nodes AS BIGINT) AS dense_bytes,
                CASE WHEN n.n_nodes < 2 THEN 'failed' WHEN n.n_nodes > 10000 THEN 'too_large' ELSE 'ok' END AS status
         FROM (SELECT binary_id, count(*) AS n_nodes FROM nodes GROUP BY binary_id) n
         LEFT JOIN (SELECT binary_id, count(*) AS n_edges FROM (SELECT DISTINCT binary_id, src, dst FROM edges) GROUP BY binary_id) e
         ON n.binary_id = e.binary_id)
"""


def _edges(spark, sf):
    return G.transition_edges(si.events(spark, sf), "user_id", ["ts", "event_id"], "event_type")


def _graph(spark, sf):
    e = _edges(spark, sf)
    n = G.graph_nodes(e)
    return e, n


@query("adjacency_edges", EDGES + """
SELECT DISTINCT e.binary_id, e.src, e.dst, a.node_idx AS src_idx, b.node_idx AS dst_idx
FROM edges e JOIN nodes a ON e.binary_id = a.binary_id AND e.src = a.node
JOIN nodes b ON e.binary_id = b.binary_id AND e.dst = b.node""")
def q_adjacency(spark, sf):
    e, n = _graph(spark, sf)
    return G.adjacency(e, n)


@query("graph_size_gate", EDGES + "SELECT * FROM gate")
def q_size_gate(spark, sf):
    e, n = _graph(spark, sf)
    return G.size_gate(n, e)


@query("graph_run_report", EDGES + LINES.replace("WITH lines", ", lines") + """
SELECT 'status' AS metric, status AS key, count(*) AS n FROM gate GROUP BY status
UNION ALL SELECT 'unknown_opcodes', 'tokens', cast(count(*) AS BIGINT) FROM toks WHERE opcode NOT IN (SELECT opcode FROM dict)""")
def q_run_report(spark, sf):
    e, n = _graph(spark, sf)
    unk = G.unknown_opcodes(_tokens(spark, sf), dictionary_frame(spark, WORD_CATEGORIES))
    return G.run_report(G.size_gate(n, e), unk)


@query("fallback_union", EDGES + """
, pe AS (SELECT * FROM edges WHERE src <> 'error' AND dst <> 'error'),
pnodes AS (SELECT binary_id, count(*) AS k FROM (SELECT binary_id, src AS node FROM pe UNION SELECT binary_id, dst FROM pe) GROUP BY binary_id),
pok AS (SELECT binary_id FROM pnodes WHERE k >= 2 AND k <= 10000)
SELECT binary_id, src, dst, 'primary' AS method FROM pe WHERE binary_id IN (SELECT binary_id FROM pok)
UNION ALL
SELECT binary_id, src, dst, 'fallback' FROM edges WHERE binary_id NOT IN (SELECT binary_id FROM pok)""")
def q_fallback(spark, sf):
    e = _edges(spark, sf)
    primary = e.filter((F.col("src") != "error") & (F.col("dst") != "error"))  # a method that misses error nodes
    gate = G.size_gate(G.graph_nodes(primary), primary)
    return G.fallback_union(primary, e, gate)


@query("graph_features", EDGES + """
, de AS (SELECT DISTINCT binary_id, src, dst FROM edges),
od AS (SELECT binary_id, max(d) AS max_out_degree FROM (SELECT binary_id, src, count(*) AS d FROM de GROUP BY ALL) GROUP BY ALL),
ne AS (SELECT binary_id, count(*) AS n_edges, sum(CASE WHEN src = dst THEN 1 ELSE 0 END) AS self_loops FROM de GROUP BY ALL),
nn AS (SELECT binary_id, count(*) AS n_nodes FROM nodes GROUP BY ALL),
w AS (SELECT user_id AS binary_id, avg(cnt) AS mean_node_weight, max(cnt) AS max_node_weight
      FROM (SELECT user_id, event_type, count(*) AS cnt FROM events GROUP BY ALL) GROUP BY ALL)
SELECT nn.binary_id, nn.n_nodes, cast(coalesce(ne.n_edges, 0) AS BIGINT) AS n_edges,
       round(CASE WHEN nn.n_nodes > 1 THEN coalesce(ne.n_edges, 0) / (nn.n_nodes * (nn.n_nodes - 1)) ELSE 0.0e0 END, 6) AS density,
       cast(coalesce(od.max_out_degree, 0) AS BIGINT) AS max_out_degree,
       round(coalesce(ne.n_edges, 0) / nn.n_nodes, 6) AS mean_out_degree,
       cast(coalesce(ne.self_loops, 0) AS BIGINT) AS self_loops,
       round(w.mean_node_weight, 6) AS mean_node_weight, w.max_node_weight
FROM nn LEFT JOIN ne ON nn.binary_id = ne.binary_id LEFT JOIN od ON nn.binary_id = od.binary_id
LEFT JOIN w ON nn.binary_id = w.binary_id""")
def q_graph_features(spark, sf):
    e, n = _graph(spark, sf)
    ev = si.events(spark, sf)
    weights = ev.groupBy(F.col("user_id").alias("binary_id"), "event_type").agg(F.count(F.lit(1)).alias("weight"))
    g = G.graph_level_features(n, e, weights)
    return g.select("binary_id", "n_nodes", "n_edges", F.round("density", 6).alias("density"), "max_out_degree",
                    F.round("mean_out_degree", 6).alias("mean_out_degree"), "self_loops",
                    F.round("mean_node_weight", 6).alias("mean_node_weight"), "max_node_weight")


@query("sample_n", "SELECT doc_id FROM documents ORDER BY md5(cast(doc_id AS VARCHAR)) LIMIT 10")
def q_sample_n(spark, sf):
    # exact-size sample: the limit is the feature (top-n by a hash order)
    d = table(spark, sf, "documents", "doc_id")
    return d.orderBy(md5_key("doc_id")).limit(10)


@query("page_links", """
WITH a AS (
  SELECT page_id, url, cast(generate_subscripts(regexp_extract_all(html, '<a href="([^"]*)"[^>]*>([^<]*)</a>', 1), 1) - 1 AS INTEGER) AS pos,
         unnest(regexp_extract_all(html, '<a href="([^"]*)"[^>]*>([^<]*)</a>', 1)) AS href,
         unnest(regexp_extract_all(html, '<a href="([^"]*)"[^>]*>([^<]*)</a>', 2)) AS name FROM pages),
l AS (SELECT page_id, name, max(pos) AS pos FROM a GROUP BY ALL)
SELECT a.page_id, a.name, a.pos, a.href,
       CASE WHEN starts_with(a.href, '/') THEN regexp_extract(a.url, '^(https?://[^/?#]+)', 1) || a.href ELSE a.href END AS abs_url
FROM a JOIN l ON a.page_id = l.page_id AND a.name = l.name AND a.pos = l.pos""")
def q_page_links(spark, sf):
    return page_links(table(spark, sf, "pages", "page_id", "url", "html"))
