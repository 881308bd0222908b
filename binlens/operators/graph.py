"""Control-flow graph features (B13-B23) from instruction, block and edge tables.

The graph is never a dense matrix: nodes and edges stay tables keyed by ``binary_id`` and all
steps are joins and grouped aggregates (map-side combined), so one huge binary is spread over
many tasks instead of one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from binlens.functions.ranking import group_position
from binlens.functions.sizing import maybe_broadcast

MIN_NODES = 2
MAX_NODES = 10_000


def mnemonic_tokens(instructions: DataFrame) -> DataFrame:
    """Instruction text ``'addr:\\tmnemonic\\toperands'`` -> one row per blank-separated token of
    the mnemonic field (prefixes such as rep / lock count as tokens; operands never do)."""
    field = F.split(F.col("text"), "\t").getItem(1)
    toks = instructions.select("binary_id", "node_idx", F.explode(F.split(F.coalesce(field, F.lit("")), r"\s+")).alias("opcode"))
    return toks.filter(F.col("opcode") != "").withColumn("opcode", F.lower(F.col("opcode")))


def category_counts(tokens: DataFrame, dictionary: DataFrame, categories: list[str]) -> DataFrame:
    """Per block and category, the number of tokens in that category (a token listed in two
    categories counts in both). The dictionary side is broadcast when its capped count proves it
    small, and shuffle-joined otherwise."""
    hits = tokens.join(maybe_broadcast(dictionary), "opcode")
    wide = hits.groupBy("binary_id", "node_idx").pivot("category", categories).agg(F.count(F.lit(1)))
    return wide.fillna(0, subset=categories).select(
        "binary_id", "node_idx", *[F.col(c).cast("bigint").alias(c) for c in categories])


def unknown_opcodes(tokens: DataFrame, dictionary: DataFrame) -> DataFrame:
    """Corpus-wide counts of tokens that are in no category."""
    known = maybe_broadcast(dictionary.select("opcode").distinct())
    return tokens.join(known, "opcode", "left_anti").groupBy("opcode").agg(F.count(F.lit(1)).alias("n"))


def block_features(blocks: DataFrame, counts: DataFrame, categories: list[str]) -> DataFrame:
    """Node feature rows: block size then one count per category; blocks without code (API
    stubs) keep all-zero counts."""
    j = blocks.join(counts, ["binary_id", "node_idx"], "left")
    return j.select("binary_id", "node_idx", "size",
                    *[F.coalesce(F.col(c), F.lit(0)).cast("bigint").alias(c) for c in categories])


def block_totals(blocks: DataFrame, categories: list[str], labels: DataFrame | None = None) -> DataFrame:
    """Per binary, from its block features: number of blocks, mean and largest block size, tokens of each
    category; and its class where ``labels`` (binary_id, label) has one (null otherwise)."""
    out = blocks.groupBy("binary_id").agg(
        F.count(F.lit(1)).alias("n_blocks"), F.avg("size").alias("mean_block_size"), F.max("size").alias("max_block_size"),
        *[F.sum(c).alias(f"total_{c}") for c in categories])
    return out if labels is None else out.join(labels.select("binary_id", "label"), "binary_id", "left")


def transition_edges(events: DataFrame, group: str, order: list[str], node: str) -> DataFrame:
    """Edge from each event's node to the next event's node within its group.

    Equivalent to ``lead(node) over (partition by group order by ...)`` but the positions come
    from a range-partitioned sort and the pairing is an equi-join on (group, position), so a
    group with a third of all events is still spread over many tasks.
    """
    pos = group_position(events.select(group, node, *order), [group], order, name="_pos")
    a = pos.select(F.col(group).alias("binary_id"), F.col("_pos"), F.col(node).alias("src"))
    b = pos.select(F.col(group).alias("binary_id"), (F.col("_pos") - 1).alias("_pos"), F.col(node).alias("dst"))
    return a.join(b, ["binary_id", "_pos"]).select("binary_id", "src", "dst")


def graph_nodes(edges: DataFrame, extra_nodes: DataFrame | None = None) -> DataFrame:
    """Distinct nodes per binary with index = position by node name - 1."""
    nodes = edges.select("binary_id", F.col("src").alias("node")).union(edges.select("binary_id", F.col("dst").alias("node")))
    if extra_nodes is not None:
        nodes = nodes.union(extra_nodes.select("binary_id", "node"))
    nodes = nodes.distinct()
    return group_position(nodes, ["binary_id"], ["node"], name="node_idx").withColumn(
        "node_idx", (F.col("node_idx") - 1).cast("int"))


def adjacency(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Sparse boolean adjacency: parallel edges collapse; (binary_id, src, dst, src_idx, dst_idx)."""
    e = edges.select("binary_id", "src", "dst").distinct()
    n = nodes.select("binary_id", "node", "node_idx")
    return (e.join(n.withColumnRenamed("node", "src").withColumnRenamed("node_idx", "src_idx"), ["binary_id", "src"])
             .join(n.withColumnRenamed("node", "dst").withColumnRenamed("node_idx", "dst_idx"), ["binary_id", "dst"])
             .select("binary_id", "src", "dst", "src_idx", "dst_idx"))


def size_gate(nodes: DataFrame, edges: DataFrame, min_nodes: int = MIN_NODES, max_nodes: int = MAX_NODES) -> DataFrame:
    """(binary_id, n_nodes, n_edges, dense_bytes, status): fewer than ``min_nodes`` -> failed,
    more than ``max_nodes`` -> too_large (a dense boolean matrix would need n*n bytes)."""
    nn = nodes.groupBy("binary_id").agg(F.count(F.lit(1)).alias("n_nodes"))
    ne = edges.select("binary_id", "src", "dst").distinct().groupBy("binary_id").agg(F.count(F.lit(1)).alias("n_edges"))
    g = nn.join(ne, "binary_id", "left").fillna(0, subset=["n_edges"])
    status = (F.when(F.col("n_nodes") < min_nodes, F.lit("failed"))
              .when(F.col("n_nodes") > max_nodes, F.lit("too_large")).otherwise(F.lit("ok")))
    return g.select("binary_id", "n_nodes", F.col("n_edges").cast("bigint").alias("n_edges"),
                    (F.col("n_nodes") * F.col("n_nodes")).cast("bigint").alias("dense_bytes"), status.alias("status"))


def fallback_union(primary: DataFrame, fallback: DataFrame, primary_gate: DataFrame) -> DataFrame:
    """Edges of the primary method where its graph passes the gate, otherwise the fallback's."""
    ok = primary_gate.filter(F.col("status") == "ok").select("binary_id")
    p = primary.join(ok, "binary_id", "left_semi").withColumn("method", F.lit("primary"))
    f = fallback.join(ok, "binary_id", "left_anti").withColumn("method", F.lit("fallback"))
    return p.unionByName(f)


def run_report(gate: DataFrame, unknown: DataFrame | None = None) -> DataFrame:
    """(metric, key, n): binaries per gate status, plus unknown-token totals when given."""
    parts = [gate.groupBy(F.lit("status").alias("metric"), F.col("status").alias("key"))
             .agg(F.count(F.lit(1)).alias("n"))]
    if unknown is not None:
        parts.append(unknown.agg(F.sum("n").alias("n")).select(F.lit("unknown_opcodes").alias("metric"),
                                                             F.lit("tokens").alias("key"), F.col("n").cast("bigint")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def graph_level_features(nodes: DataFrame, edges: DataFrame, node_weights: DataFrame | None = None) -> DataFrame:
    """Per-binary aggregates so graphs can feed the same classifiers: nodes, distinct edges,
    density, out-degree max / mean, self loops, and (optionally) node weight mean / max."""
    e = edges.select("binary_id", "src", "dst").distinct()
    outdeg = e.groupBy("binary_id", "src").agg(F.count(F.lit(1)).alias("d"))
    deg = outdeg.groupBy("binary_id").agg(F.max("d").alias("max_out_degree"))
    ne = e.groupBy("binary_id").agg(F.count(F.lit(1)).alias("n_edges"),
                                    F.sum((F.col("src") == F.col("dst")).cast("bigint")).alias("self_loops"))
    nn = nodes.groupBy("binary_id").agg(F.count(F.lit(1)).alias("n_nodes"))
    g = nn.join(ne, "binary_id", "left").join(deg, "binary_id", "left").fillna(0)
    out = g.select(
        "binary_id", "n_nodes", F.col("n_edges").cast("bigint").alias("n_edges"),
        F.when(F.col("n_nodes") > 1, F.col("n_edges") / (F.col("n_nodes") * (F.col("n_nodes") - 1)))
         .otherwise(F.lit(0.0)).alias("density"),
        F.col("max_out_degree").cast("bigint").alias("max_out_degree"),
        (F.col("n_edges") / F.col("n_nodes")).alias("mean_out_degree"),
        F.col("self_loops").cast("bigint").alias("self_loops"))
    if node_weights is not None:
        w = node_weights.groupBy("binary_id").agg(F.avg("weight").alias("mean_node_weight"),
                                                  F.max("weight").alias("max_node_weight"))
        out = out.join(w, "binary_id", "left")
    return out


def write_graph_tables(nodes: DataFrame, edges: DataFrame, labels: DataFrame, root: str, buckets: int = 64) -> None:
    """Graph bundle sink (A7): nodes, edges and labels as parquet tables partitioned by a hash
    bucket of ``binary_id`` - a bounded number of folders, never one file per binary - so a
    reader of one graph prunes to one bucket."""
    bucket = F.pmod(F.xxhash64(F.col("binary_id")), F.lit(buckets)).alias("bucket")
    for name, df in (("nodes", nodes), ("edges", edges), ("labels", labels)):
        (df.select("*", bucket).repartition(buckets, "bucket")
           .write.mode("overwrite").partitionBy("bucket").parquet(f"{root.rstrip('/')}/{name}"))

