"""From a question to its evidence: lexical and vector entry points, PageRank, top nodes, subgraph, prompt."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.functions.text import hit_count, jaccard, words
from loomgraph.operators.graph import induced
from loomgraph.plans.skew import skew_join

TYPES = ("T", "S", "H", "R")


def lexical_hits(questions: DataFrame, nodes: DataFrame, threshold: float = 0.3) -> DataFrame:
    """(uid, id, score) of N and O nodes whose token Jaccard with the question exceeds the threshold.

    Prefix filter: the shared tokens number at least floor(t (|x| + dot)) + 1 of either
    set x, where dot is 1 unless the set has the token "." itself, so two such sets
    share one of the first |x| - floor(t (|x| + dot)) tokens of each, in one order,
    here by rarity among the nodes; and neither set is smaller than that number of
    the other. Only these tokens are joined. A token of many nodes is split by ``skew_join``
    where its rank is looked up.
    """
    q = questions.select("uid", F.array_distinct(words(F.lower("question"))).alias("qt")).where("size(qt) > 0")
    n = nodes.where("type in ('N', 'O')").select("id", F.array_distinct(words(F.lower("text"))).alias("nt")).where("size(nt) > 0")
    freq = n.select(F.explode("nt").alias("tok")).groupBy("tok").agg(F.count("*").alias("f")).persist()

    def prefix(df: DataFrame, key: str, toks: str) -> DataFrame:
        size = F.size(toks)
        least = F.floor(F.lit(threshold) * (size + F.when(F.array_contains(toks, "."), 0).otherwise(1))) + 1
        e = df.select(key, F.explode(toks).alias("tok"), size.alias("len"), least.alias("least"))
        e = skew_join(e, freq, ["tok"], freq.withColumnRenamed("f", "n"), "left")
        w = Window.partitionBy(key).orderBy(F.coalesce("f", F.lit(0)), "tok")
        e = e.withColumn("r", F.row_number().over(w)).where(F.col("r") <= F.col("len") - F.col("least") + 1)
        return e.select(key, "tok", F.col("len").alias(f"len_{key}"), F.col("least").alias(f"least_{key}"))

    pairs = prefix(q, "uid", "qt").join(prefix(n, "id", "nt"), "tok").where("len_uid >= least_id and len_id >= least_uid").select("uid", "id").distinct()
    s = pairs.join(q, "uid").join(n, "id").select("uid", "id", jaccard(F.col("qt"), F.col("nt")).alias("score"))
    return s.where(F.col("score") > threshold).withColumn("score", F.round("score", 6))


def entry_points(lexical: DataFrame, vector: DataFrame) -> DataFrame:
    """(uid, id, weight): both sets united, uniform weights."""
    u = lexical.select("uid", "id").unionByName(vector.select("uid", "id")).distinct()
    n = u.groupBy("uid").agg(F.count("*").alias("n"))
    return u.join(n, "uid").select("uid", "id", (F.lit(1.0) / F.col("n")).alias("weight"))


def reached(entry: DataFrame, edges: DataFrame, steps: int = 2) -> DataFrame:
    """The edges that ``steps`` steps from the entry points can use: those out of the entry points and of what these lead to.

    A source keeps all its edges, so its probabilities stay the same.
    """
    front = entry.select("id").distinct()
    seen = front
    for _ in range(steps - 1):
        front = edges.join(front.withColumnRenamed("id", "src"), "src", "left_semi").select(F.col("dst").alias("id")).distinct()
        seen = seen.unionByName(front)
    return edges.join(seen.distinct().withColumnRenamed("id", "src"), "src", "left_semi")


def transitions(edges: DataFrame, direction: str = "out") -> DataFrame:
    """(src, dst, p): weights of parallel edges summed, over the source's total; 'both' also walks edges backwards."""
    e = edges.select("src", "dst", F.coalesce("weight", F.lit(1)).cast("double").alias("w"))
    if direction == "both":
        e = e.unionByName(e.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "w"))
    e = e.groupBy("src", "dst").agg(F.sum("w").alias("w"))
    total = e.groupBy("src").agg(F.sum("w").alias("t"))
    return e.join(total, "src").select("src", "dst", (F.col("w") / (F.col("t") + 1e-8)).alias("p"))


def shallow_ppr(entry: DataFrame, trans: DataFrame, alpha: float = 0.5, steps: int = 2) -> DataFrame:
    """(uid, id, score) after ``steps`` steps; mass at nodes without outgoing edges is lost. Only reached nodes are held."""
    p0 = entry.select("uid", "id", (alpha * F.col("weight")).alias("s"))
    cur = entry.select("uid", "id", F.col("weight").alias("s"))
    for _ in range(steps):
        moved = cur.join(trans, F.col("id") == F.col("src")).select("uid", F.col("dst").alias("id"), ((1 - alpha) * F.col("s") * F.col("p")).alias("s"))
        cur = p0.unionByName(moved).groupBy("uid", "id").agg(F.sum("s").alias("s"))
    return cur.select("uid", "id", F.round("s", 9).alias("score"))


def top_per_type(scores: DataFrame, nodes: DataFrame, m: int = 5) -> DataFrame:
    """(uid, id, type, rank): the ``m`` best nodes of each type, ties and nodes without score by seq.

    Nodes without score only matter as the first ``m`` of their type, so no more are added.
    """
    n = nodes.where(F.col("type").isin(*TYPES)).select("id", "type", "seq")
    first = n.withColumn("r", F.row_number().over(Window.partitionBy("type").orderBy("seq"))).where(F.col("r") <= 2 * m).drop("r")
    hit = scores.where("score > 0").join(n, "id")
    fill = scores.select("uid").distinct().crossJoin(F.broadcast(first)).join(hit.select("uid", "id"), ["uid", "id"], "left_anti").withColumn("score", F.lit(0.0))  # 2 m rows a type
    w = Window.partitionBy("uid", "type").orderBy(F.desc("score"), "seq")
    all_ = hit.select("uid", "id", "type", "score", "seq").unionByName(fill.select("uid", "id", "type", "score", "seq"))
    return all_.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= m).select("uid", "id", "type", "score", "rank", "seq")


def evidence(entry: DataFrame, top: DataFrame, nodes: DataFrame) -> DataFrame:
    """(uid, id, type, text, seq): entry and top nodes of the four evidence types."""
    ids = entry.select("uid", "id").unionByName(top.select("uid", "id")).distinct()
    return ids.join(nodes.where(F.col("type").isin(*TYPES)), "id").select("uid", "id", "type", "text", "seq")


def evidence_edges(ev: DataFrame, edges: DataFrame) -> DataFrame:
    """(uid, src, dst, label): edges between nodes of one question's evidence, parallels kept."""
    e = induced(edges, ev)
    a = ev.select("uid", F.col("id").alias("src")).join(e, "src")
    return a.join(ev.select("uid", F.col("id").alias("dst")), ["uid", "dst"], "left_semi").select("uid", "src", "dst", "label")


def reasoning_hits(ev: DataFrame, chains: DataFrame) -> DataFrame:
    """(uid, id, hits, p_reason): how often each node's text stands in the reasoning, and its share after smoothing."""
    h = ev.join(chains.select("uid", "chain"), "uid").withColumn("hits", hit_count(F.col("chain"), F.col("text")))
    return h.withColumn("p_reason", F.round((F.col("hits") + 1e-6) / F.sum(F.col("hits") + 1e-6).over(Window.partitionBy("uid")), 9))


def align(ev: DataFrame, ev_edges: DataFrame, chains: DataFrame, n: int = 5) -> DataFrame:
    """(uid, id, p_reason): the ``n`` nodes that the reasoning mentions most, and their direct successors."""
    h, w = reasoning_hits(ev, chains), Window.partitionBy("uid")
    top = h.withColumn("r", F.row_number().over(w.orderBy(F.desc("p_reason"), "seq"))).where(F.col("r") <= n)
    nxt = top.select("uid", F.col("id").alias("src")).join(ev_edges, ["uid", "src"]).select("uid", F.col("dst").alias("id"))
    keep = top.select("uid", "id").unionByName(nxt).distinct()
    return h.join(keep, ["uid", "id"], "left_semi").select("uid", "id", "p_reason", "type", "text", "seq")


def textualize(ev: DataFrame, ev_edges: DataFrame) -> DataFrame:
    """(uid, graph_text): one line per node, then per edge. The evidence of a question is a few nodes."""
    clean = F.regexp_replace(F.trim(F.coalesce("text", F.lit(""))), "\n", " ")
    n = ev.select("uid", F.lit(0).alias("k"), F.col("id").alias("o1"), F.lit("").alias("o2"), F.lit("").alias("o3"), F.concat(F.lit("["), "type", F.lit(": "), "id", F.lit("] "), clean).alias("line"))
    e = ev_edges.select("uid", F.lit(1).alias("k"), F.col("src").alias("o1"), F.col("dst").alias("o2"), F.col("label").alias("o3"), F.concat(F.lit("[EDGE: "), "src", F.lit(" → "), "dst", F.lit("] "), "label").alias("line"))
    rows = n.unionByName(e).groupBy("uid").agg(F.array_sort(F.collect_list(F.struct("k", "o1", "o2", "o3", "line"))).alias("x"))
    return rows.select("uid", F.array_join(F.transform("x", lambda r: r["line"]), "\n").alias("graph_text"))


def prompt(questions: DataFrame, texts: DataFrame) -> DataFrame:
    """(uid, prompt): question and evidence in a fixed frame."""
    p = F.concat(F.lit("Answer the question from the evidence graph alone.\n\nEvidence:\n"), "graph_text", F.lit("\n\nQuestion: "), "question", F.lit("\nAnswer:"))
    return questions.select("uid", "question").join(texts, "uid").select("uid", p.alias("prompt"))


def reasoning_prompt(questions: DataFrame, ev: DataFrame) -> DataFrame:
    """(uid, prompt): question and the evidence texts in order."""
    t = ev.where("coalesce(text, '') <> ''").groupBy("uid").agg(F.array_sort(F.collect_list(F.struct("id", "text"))).alias("x"))
    t = t.select("uid", F.array_join(F.transform("x", lambda r: r["text"]), "\n").alias("context"))
    p = F.concat(F.lit("Question: "), "question", F.lit("\n\nContext:\n"), "context", F.lit("\n\nReason step by step from the context."))
    return questions.select("uid", "question").join(t, "uid").select("uid", p.alias("prompt"))
