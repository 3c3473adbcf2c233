"""The document graph as two DataFrames: G1 to G5, its JSON form and its upserts.

Order is part of the semantics (first text of a node wins, parallel edges stay), so
every node and edge carries ``seq`` = struct(chunk, phase, pos, sub) instead of a
global row number, which would need one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.functions.text import normalize_name

NODE_TYPES = ("T", "S", "N", "R", "H", "O")


def unique_chunks(chunks: DataFrame) -> DataFrame:
    """One row per chunk id; rows delivered again are equal."""
    return chunks.select("id", "book_id", "chunk_no", "text", "summary", "entities", "relations").where("id is not null").dropDuplicates(["id"])


def missing_fields():
    """Names of the fields a chunk lacks, in the order text, summary, entities, relations."""
    lack = [F.when(F.coalesce(F.col(c), F.lit("")) == "", F.lit(c)) for c in ("text", "summary")]
    lack += [F.when(F.coalesce(F.size(c), F.lit(0)) <= 0, F.lit(c)) for c in ("entities", "relations")]
    return F.array_compact(F.array(*lack))


def complete(chunks: DataFrame) -> DataFrame:
    return chunks.where(F.size(missing_fields()) == 0)


def incomplete(chunks: DataFrame) -> DataFrame:
    """(doc_id, missing_fields) of the chunks that lack something."""
    return chunks.select(F.col("id").alias("doc_id"), missing_fields().alias("missing_fields")).where(F.size("missing_fields") > 0)


def _seq(phase: int, pos=None, sub: int = 0):
    return F.struct(F.col("id").alias("c"), F.lit(phase).alias("p"), (F.lit(0) if pos is None else pos).cast("int").alias("i"), F.lit(sub).alias("s"))


def _name(c):
    return F.concat(F.lit("N_"), normalize_name(c))


def _relation_rows(chunks: DataFrame) -> DataFrame:
    r = chunks.select("id", F.posexplode("relations").alias("pos", "r")).where("r is not null")
    rid = F.concat(F.lit("R_"), F.md5(F.concat_ws("|", "id", "pos")))
    return r.select("id", "pos", rid.alias("rid"), F.col("r.Source").alias("s"), F.col("r.Relationship").alias("p"), F.col("r.Destination").alias("d"))


def _mentions(chunks: DataFrame) -> DataFrame:
    """All node mentions with their kind; a relation's end names a node without type."""
    n = chunks.select("id", F.posexplode("entities").alias("pos", "e")).where("e is not null")
    r = _relation_rows(chunks)
    null = F.lit(None).cast("string")
    return (
        chunks.select(F.concat(F.lit("T_"), "id").alias("node"), F.lit("T").alias("type"), "text", _seq(0).alias("seq"))
        .unionByName(chunks.select(F.concat(F.lit("S_"), "id").alias("node"), F.lit("S").alias("type"), F.col("summary").alias("text"), _seq(1).alias("seq")))
        .unionByName(n.select(_name(F.col("e")).alias("node"), F.lit("N").alias("type"), F.col("e").alias("text"), _seq(2, F.col("pos")).alias("seq")))
        .unionByName(r.select(F.col("rid").alias("node"), F.lit("R").alias("type"), F.col("p").alias("text"), _seq(3, F.col("pos")).alias("seq")))
        .unionByName(r.where("s is not null").select(_name(F.col("s")).alias("node"), null.alias("type"), null.alias("text"), _seq(3, F.col("pos"), 1).alias("seq")))
        .unionByName(r.where("d is not null").select(_name(F.col("d")).alias("node"), null.alias("type"), null.alias("text"), _seq(3, F.col("pos"), 2).alias("seq")))
    )


def nodes_g1(chunks: DataFrame, ghost_policy: str = "reference") -> DataFrame:
    """(id, type, text, seq): the first mention of a node wins.

    'reference': an end of a relation met before the entity stays without type;
    'promote': it takes the type and text of its first typed mention.
    """
    m = _mentions(complete(unique_chunks(chunks)))
    key = F.col("seq") if ghost_policy == "reference" else F.struct(F.col("type").isNull().alias("ghost"), F.col("seq"))
    got = m.groupBy(F.col("node").alias("id")).agg(F.min(F.struct(key.alias("k"), F.struct("type", "text").alias("v"))).alias("x"), F.min("seq").alias("seq"))
    return got.select("id", F.col("x.v.type").alias("type"), F.col("x.v.text").alias("text"), "seq")


def edges_g1(chunks: DataFrame) -> DataFrame:
    """(src, dst, label, weight, seq) multiset: derived_from, mentions, subj, obj."""
    c = complete(unique_chunks(chunks))
    n = c.select("id", F.posexplode("entities").alias("pos", "e")).where("e is not null")
    r = _relation_rows(c)
    w = F.lit(None).cast("int").alias("weight")
    t, s = F.concat(F.lit("T_"), "id"), F.concat(F.lit("S_"), "id")
    return (
        c.select(t.alias("src"), s.alias("dst"), F.lit("derived_from").alias("label"), w, _seq(1).alias("seq"))
        .unionByName(n.select(s.alias("src"), _name(F.col("e")).alias("dst"), F.lit("mentions").alias("label"), w, _seq(2, F.col("pos")).alias("seq")))
        .unionByName(r.where("s is not null").select(F.col("rid").alias("src"), _name(F.col("s")).alias("dst"), F.lit("subj").alias("label"), w, _seq(3, F.col("pos"), 1).alias("seq")))
        .unionByName(r.where("d is not null").select(F.col("rid").alias("src"), _name(F.col("d")).alias("dst"), F.lit("obj").alias("label"), w, _seq(3, F.col("pos"), 2).alias("seq")))
    )


def simple_graph(edges: DataFrame) -> DataFrame:
    """Undirected edges without parallels and attributes."""
    return edges.select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).distinct()


def induced(edges: DataFrame, keep: DataFrame) -> DataFrame:
    """Edges with both ends in ``keep`` (id)."""
    k = keep.select("id").distinct()
    return edges.join(k.withColumnRenamed("id", "src"), "src", "left_semi").join(k.withColumnRenamed("id", "dst"), "dst", "left_semi")


def snr_subgraph(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    return induced(edges, nodes.where(F.col("type").isin("S", "N", "R")))


def out_degree(edges: DataFrame) -> DataFrame:
    """(src, degree): sum of weights, a missing one counting 1."""
    return edges.groupBy("src").agg(F.sum(F.coalesce("weight", F.lit(1))).cast("bigint").alias("degree"))


def g4_edges(chunks: DataFrame, nodes: DataFrame) -> DataFrame:
    """Second derived_from edges, and mentions_entity where the name as written is a node's key."""
    c = unique_chunks(chunks).where("coalesce(text, '') <> ''")
    s = nodes.where("type = 'S'").select(F.col("id").alias("dst"))
    own = c.select("id", "entities", F.concat(F.lit("S_"), "id").alias("dst")).join(s, "dst", "left_semi")
    t = F.concat(F.lit("T_"), "id").alias("src")
    w = F.lit(None).cast("int").alias("weight")
    derived = own.select(t, "dst", F.lit("derived_from").alias("label"), w, _seq(4).alias("seq"))
    raw = own.select("id", F.posexplode("entities").alias("pos", "e")).where("e is not null").select("id", "pos", F.concat(F.lit("N_"), "e").alias("dst"))
    hits = raw.join(nodes.select(F.col("id").alias("dst")), "dst", "left_semi")
    return derived.unionByName(hits.select(t, "dst", F.lit("mentions_entity").alias("label"), w, _seq(5, F.col("pos")).alias("seq")))


def semantic_groups(points: DataFrame) -> DataFrame:
    """(cluster, community, id) -> (group_id, id): members of one cluster and community are related pairwise.

    The pairs themselves grow with the square of a group, so the relation is kept as
    membership; groups of one have no edge and are left out.
    """
    p = points.where("community is not null and cluster is not null")
    many = p.groupBy("cluster", "community").agg(F.count("*").alias("n")).where("n > 1")
    return p.join(many, ["cluster", "community"]).select(F.concat_ws("/", "cluster", "community").alias("group_id"), "id")


def final_nodes(nodes: DataFrame, ho: DataFrame) -> DataFrame:
    """G1 nodes with the H and O nodes of the communities behind them in order."""
    seq = F.struct(F.concat(F.lit("~"), "id").alias("c"), F.lit(6).alias("p"), F.lit(0).alias("i"), F.lit(0).alias("s")).alias("seq")
    return nodes.unionByName(ho.select("id", "type", "text", seq))


def dominant_axis(vec) -> object:
    """Deterministic cluster of a vector: the position of its largest coordinate by size, from 1."""
    size = F.transform(vec, lambda x: F.abs(x))
    return F.array_position(size, F.array_max(size))


def g5_edges(edges: DataFrame, near: DataFrame, communities: DataFrame, groups: DataFrame | None = None) -> DataFrame:
    """(src, dst, label, weight): the graph after the nearest-neighbour step.

    A pair (src, dst) counts if both communities are equal, NULL equalling NULL. Where
    it has edges, all its parallels gain weight 1 (a missing one counting 1); else an
    edge semantic_hnsw of weight 1 is new. ``groups`` (group_id, id) holds the edges
    semantically_related, which lead from each member to those behind it by id: such
    a pair has an edge, so it comes out with that label and weight 2; the pairs of a
    group that are not near keep weight 1 and stay in the membership alone.
    """
    c = communities.select("id", "community")
    p = near.where("src <> dst").select("src", "dst").distinct()
    p = p.join(c.select(F.col("id").alias("src"), F.col("community").alias("ca")), "src", "left").join(c.select(F.col("id").alias("dst"), F.col("community").alias("cb")), "dst", "left")
    p = p.where(F.col("ca").eqNullSafe(F.col("cb"))).select("src", "dst")
    up = edges.join(p.withColumn("hit", F.lit(1)), ["src", "dst"], "left")
    up = up.select("src", "dst", "label", F.when(F.col("hit").isNotNull(), F.coalesce("weight", F.lit(1)) + 1).otherwise(F.col("weight")).cast("int").alias("weight"))
    new = p.join(edges.select("src", "dst"), ["src", "dst"], "left_anti")
    out = up
    if groups is not None:
        g = groups.select("group_id", "id").distinct()
        related = p.where("src < dst").join(g.select(F.col("id").alias("src"), "group_id"), "src").join(g.select(F.col("id").alias("dst"), "group_id"), ["dst", "group_id"]).select("src", "dst").distinct()
        out = up.unionByName(related.select("src", "dst", F.lit("semantically_related").alias("label"), F.lit(2).alias("weight")))
        new = new.join(related, ["src", "dst"], "left_anti")
    return out.unionByName(new.select("src", "dst", F.lit("semantic_hnsw").alias("label"), F.lit(1).alias("weight")))


def upsert_nodes(old: DataFrame, new: DataFrame) -> DataFrame:
    """MERGE by id; the new type and text win."""
    a = new.select("id", "type", "text").dropDuplicates(["id"])
    return old.select("id", "type", "text").join(a, "id", "left_anti").unionByName(a)


def upsert_edges(old: DataFrame, new: DataFrame) -> DataFrame:
    """MERGE by (src, dst, label): parallels collapse, weights are dropped."""
    return old.select("src", "dst", "label").unionByName(new.select("src", "dst", "label")).distinct()


def to_json(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Rows of the JSON lines form: (kind, json), one object per node and edge, NULL fields included; ``seq`` is kept where the inputs have it."""
    keep, full = (["seq"] if "seq" in nodes.columns and "seq" in edges.columns else []), {"ignoreNullFields": "false"}
    n = nodes.select(F.lit("node").alias("kind"), F.to_json(F.struct("id", "type", "text"), full).alias("json"), *keep)
    e = edges.select(F.lit("edge").alias("kind"), F.to_json(F.struct(F.col("src").alias("source"), F.col("dst").alias("target"), "label", "weight"), full).alias("json"), *keep)
    return n.unionByName(e)


def from_json(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of the rows of ``to_json``; of a pair's edges the last one wins, by ``seq`` where the rows have it."""
    n = rows.where("kind = 'node'").select(F.from_json("json", "id string, type string, text string").alias("x")).select("x.*")
    order = F.col("seq") if "seq" in rows.columns else F.col("json")
    e = rows.where("kind = 'edge'").select(F.from_json("json", "source string, target string, label string, weight int").alias("x"), order.alias("seq"))
    return n, collapse_parallel(e.select(F.col("x.source").alias("src"), F.col("x.target").alias("dst"), "x.label", "x.weight", "seq"))


def collapse_parallel(edges: DataFrame) -> DataFrame:
    """Edges after a round trip through a graph without parallels: the last attributes of a pair win."""
    return edges.groupBy("src", "dst").agg(F.max_by(F.struct("label", "weight"), "seq").alias("x")).select("src", "dst", "x.label", "x.weight")


def offsets(df: DataFrame, group: str, order: str, size, block: int = 4096) -> DataFrame:
    """Start of each row in the concatenation of its group, in the order of a bigint column.

    Sums of blocks of the order column come first, so that no task holds a whole group.
    """
    b = df.withColumn("_b", F.floor(F.col(order) / block)).withColumn("_n", size.cast("bigint"))
    sums = b.groupBy(group, "_b").agg(F.sum("_n").alias("_s"))
    up = Window.partitionBy(group).orderBy("_b")
    sums = sums.withColumn("_before", F.sum("_s").over(up) - F.col("_s")).select(F.col(group).alias("_g"), F.col("_b").alias("_c"), "_before")
    own = Window.partitionBy(group, "_b").orderBy(order)
    x = b.withColumn("_own", F.sum("_n").over(own) - F.col("_n"))
    x = x.join(sums, F.col(group).eqNullSafe(F.col("_g")) & (F.col("_b") == F.col("_c")))
    return x.withColumn("start_pos", F.col("_before") + F.col("_own")).drop("_b", "_n", "_g", "_c", "_before", "_own")
