"""The two entry points as one call each: build the graph of a chunk table, and answer or evaluate questions from it.

The graph, its communities and the vector index are tables of the store, so that a
question reads them and never builds or embeds them again.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.operators import community, graph, knn, retrieval
from loomgraph.operators.documents import OfflineModel, ask_model
from loomgraph.operators.evaluation import full_summary
from loomgraph.plans.runtime import cut, stored

DIM, TOP_K = 384, 10


@dataclass
class Graph:
    """Stored tables: nodes (id, type, text, seq), edges (src, dst, label, weight), communities (id, community), index (ids, flat)."""

    nodes: DataFrame
    edges: DataFrame
    communities: DataFrame
    index: DataFrame


def clusters(nodes: DataFrame, k: int | None = None, seed: int = 42) -> DataFrame:
    """(id, cluster) of the S and H nodes by KMeans over their embedded texts; k is the root of their number unless given."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    e = cut(knn.sparse_embed(nodes.where("type in ('S', 'H') and text is not null"), "id", "text", DIM))
    n = e.count()
    if not n:
        return e.select("id", F.lit(0).alias("cluster"))
    points = e.select("id", array_to_vector("vec").alias("features"))
    return KMeans(k=k or max(2, int(n**0.5 + 0.999)), seed=seed, maxIter=10).fit(points).transform(points).select("id", F.col("prediction").alias("cluster"))


def build(spark: SparkSession, chunks: DataFrame, key: str, near: DataFrame | None = None, cluster: DataFrame | None = None, find=None) -> Graph:
    """Entry point A: chunks to the stored graph. ``key`` names the state of the inputs.

    ``find`` (nodes, edges -> id, community) detects communities, by modularity unless
    given; ``cluster`` (id, cluster) groups the S nodes, by KMeans unless given; ``near``
    (src, dst) are the pairs of the nearest-neighbour step, which is left out without them.
    """
    n1 = stored(spark, "g1_nodes", key, lambda: graph.nodes_g1(chunks))
    e1 = stored(spark, "g1_edges", key, lambda: graph.edges_g1(chunks))

    def found() -> DataFrame:
        return (find or community.communities)(n1.where(F.col("type").isin("S", "N", "R")), cut(graph.snr_subgraph(n1, e1)))

    c = stored(spark, "communities", key, found)
    texts = stored(spark, "community_texts", key, lambda: community.titles(cut(community.community_context(n1, e1, c))))
    nodes = stored(spark, "nodes", key, lambda: graph.final_nodes(n1, community.ho_nodes(texts)))

    def last() -> DataFrame:
        w = F.lit(None).cast("int").alias("weight")
        e = e1.select("src", "dst", "label", "weight").unionByName(community.ho_edges(texts, n1, c).select("src", "dst", "label", w)).unionByName(graph.g4_edges(chunks, n1).select("src", "dst", "label", "weight"))
        if near is None:
            return e
        groups = graph.semantic_groups((clusters(nodes) if cluster is None else cluster).join(c, "id").join(n1.where("type = 'S'").select("id"), "id", "left_semi"))
        return graph.g5_edges(e, near, c, groups)

    edges = stored(spark, "edges", key, last)
    index = stored(spark, "index", key, lambda: knn.build_index(knn.sparse_embed(nodes.where("type in ('T', 'S', 'H')"), "id", "text", DIM), "id", "vec", DIM))
    return Graph(nodes, edges, c, index)


def retrieve(g: Graph, questions: DataFrame, top_k: int = TOP_K) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(entry points, scores, evidence, its edges) of (uid, question)."""
    near = knn.search(g.index, knn.sparse_embed(questions, "uid", "question", DIM), "uid", "vec", top_k, DIM).select(F.col("query_id").alias("uid"), "id")
    entry = cut(retrieval.entry_points(retrieval.lexical_hits(questions, g.nodes), near))
    scores = cut(retrieval.shallow_ppr(entry, retrieval.transitions(retrieval.reached(entry, g.edges))))
    ev = cut(retrieval.evidence(entry, retrieval.top_per_type(scores, g.nodes), g.nodes))
    return entry, scores, ev, cut(retrieval.evidence_edges(ev, g.edges))


def answer(g: Graph, questions: DataFrame, model: type = OfflineModel, top_k: int = TOP_K, n: int = 5) -> DataFrame:
    """Entry point B: (uid, question, reasoning_chain, prompt, answer) of (uid, question); what the model failed at is NULL."""
    _, _, ev, edges = retrieve(g, questions, top_k)
    chains = cut(ask_model(retrieval.reasoning_prompt(questions, ev), model, "reasoning", ["prompt"], "chain").select("uid", "chain"))
    kept = cut(retrieval.align(ev, edges, chains.where("chain is not null"), n))
    inner = edges.join(kept.select("uid", F.col("id").alias("src")), ["uid", "src"], "left_semi").join(kept.select("uid", F.col("id").alias("dst")), ["uid", "dst"], "left_semi")
    prompts = retrieval.prompt(questions, retrieval.textualize(kept, inner))
    done = ask_model(prompts, model, "answer", ["prompt"], "answer")
    return questions.select("uid", "question").join(chains.withColumnRenamed("chain", "reasoning_chain"), "uid", "left").join(done, "uid", "left")


def evaluate(g: Graph, questions: DataFrame, model: type = OfflineModel, vocabulary: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Entry point C: (dump, summary) of questions (id, question, answers): every stage's result, and one row of mean metrics."""
    got = answer(g, questions.select(F.col("id").alias("uid"), "question"), model)
    dump = cut(questions.select("id", F.col("question").alias("query"), F.array("answers").alias("answers")).join(got.withColumnRenamed("uid", "id").drop("question"), "id", "left"))
    return dump, full_summary(dump, vocabulary) if vocabulary else full_summary(dump)


def close(spark: SparkSession) -> None:
    """End the session; the store stays."""
    spark.stop()
