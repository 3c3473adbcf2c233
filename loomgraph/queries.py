"""Queries of the core engine: ``name -> f(spark, sf_dir)``, and the SQL of those that SQL can express."""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.functions.text import parse_entities, parse_relations, words
from loomgraph.functions.tokens import token_counts
from loomgraph.operators import community, documents, evaluation, gnn, graph, knn, nested, retrieval
from loomgraph.plans import pipeline
from loomgraph.plans.runtime import cut, fingerprint, stored
from loomgraph.sources.io import chunk_range
from loomgraph.sources.tables import table
from loomgraph.sql import ORACLE

Query = Callable[[SparkSession, str], DataFrame]


class _Tables:
    """The tables and the stages that several queries share, for one data folder.

    A stage that others read more than once is written to the shared folder first, so
    that it is computed once and its lineage ends there.
    """

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def t(self, name: str) -> DataFrame:
        return table(self.spark, self.dir, name)

    @cached_property
    def chunks(self) -> DataFrame:
        return graph.unique_chunks(self.t("chunked_output"))

    @cached_property
    def key(self) -> str:
        """State of the tables that the graph is built from."""
        return fingerprint(self.spark, [f"{self.dir}/{t}.parquet" for t in ("chunked_output", "graph_embeddings")])

    @cached_property
    def nodes(self) -> DataFrame:
        return graph.nodes_g1(self.t("chunked_output"))

    @cached_property
    def edges(self) -> DataFrame:
        return graph.edges_g1(self.t("chunked_output"))

    @cached_property
    def kept(self) -> tuple[DataFrame, DataFrame]:
        """G1, from the store."""
        return stored(self.spark, "g1_nodes", self.key, lambda: self.nodes), stored(self.spark, "g1_edges", self.key, lambda: self.edges)

    @cached_property
    def snr(self) -> tuple[DataFrame, DataFrame]:
        nodes, edges = self.kept
        return nodes.where(F.col("type").isin("S", "N", "R")), cut(graph.snr_subgraph(nodes, edges))

    @cached_property
    def communities(self) -> DataFrame:
        """A fixed number of rounds, so that SQL can follow."""
        return stored(self.spark, "communities", self.key, lambda: community.label_propagation(*self.snr, rounds=2))

    @cached_property
    def axes(self) -> DataFrame:
        """(id, cluster) of the stored vectors' nodes: a stand-in for KMeans that SQL can follow."""
        one = self.vectors.where("size(embedding) = 64 and not exists(embedding, x -> x is null or isnan(x)) and exists(embedding, x -> x <> 0)")
        return one.groupBy("id").agg(F.min_by(graph.dominant_axis(F.col("embedding")), "vec_id").alias("cluster"))

    @cached_property
    def final(self) -> pipeline.Graph:
        """The whole graph, G1 to G5, and its index: built once and stored."""
        return pipeline.build(self.spark, self.t("chunked_output"), self.key, _graph_near(self), self.axes, lambda n, e: community.label_propagation(n, e, rounds=2))

    @cached_property
    def questions(self) -> DataFrame:
        """The stated query set: questions whose number is divisible by 100."""
        q = self.t("musique").where("id is not null and question is not null").select(F.col("id").alias("uid"), "question").dropDuplicates(["uid"])
        return q.where("cast(nullif(regexp_extract(uid, '([0-9]+)$', 1), '') as bigint) % 100 = 0")

    @cached_property
    def retrieved(self) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
        return pipeline.retrieve(self.final, self.questions)

    @property
    def entry(self) -> DataFrame:
        return self.retrieved[0]

    @property
    def scores(self) -> DataFrame:
        return self.retrieved[1]

    @property
    def top(self) -> DataFrame:
        return retrieval.top_per_type(self.scores, self.final.nodes)

    @property
    def evidence(self) -> DataFrame:
        return self.retrieved[2]

    @property
    def evidence_edges(self) -> DataFrame:
        return self.retrieved[3]

    @cached_property
    def vectors(self) -> DataFrame:
        v = self.t("graph_embeddings").where("id is not null and vec_id is not null").select("vec_id", "id", "embedding")
        return v.dropDuplicates(["vec_id"])


def _q(f: Callable[[_Tables], DataFrame]) -> Query:
    return lambda spark, sf_dir: f(_Tables(spark, sf_dir))


def _doc_concat(t: _Tables) -> DataFrame:
    d = t.t("documents").select("doc_id", F.coalesce("book_id", F.lit(-1)).alias("book_id"), "text")
    return graph.offsets(d, "book_id", "doc_id", F.length(F.coalesce("text", F.lit("")))).select("book_id", "doc_id", "start_pos")


def _page_text(t: _Tables) -> DataFrame:
    """A book's documents as its pages, numbered from 0 in the order of their ids."""
    d = t.t("documents").where("book_id is not null").select("doc_id", "book_id", "text")
    return graph.offsets(d, "book_id", "doc_id", F.lit(1)).select("book_id", F.col("start_pos").alias("page_no"), F.coalesce("text", F.lit("")).alias("text"))


def _graph_embedding(t: _Tables) -> DataFrame:
    """(uid, pos, mean): the mean of the embedded evidence texts of each question."""
    ev = t.evidence.where("text is not null").select(F.concat_ws("|", "uid", "id").alias("k"), "uid", "text")
    return knn.mean_pool(knn.sparse_embed(ev, "k", "text").join(ev.select("k", "uid"), "k"), "uid", "vec")


def _embeddings_knn(t: _Tables, k: int, skip: bool) -> DataFrame:
    e = t.t("embeddings").select(F.col("vec_id"), "embedding")
    r = knn.top_k(e.where("vec_id % 100 = 0"), "vec_id", "embedding", e, "vec_id", "embedding", k, 64, skip)
    return r.select(F.col("query_id").cast("bigint").alias("query_id"), F.col("id").cast("bigint").alias("id"), "rank", "score")


def _graph_near(t: _Tables) -> DataFrame:
    v = cut(t.vectors)
    q = v.where("vec_id % 100 = 0")
    n = knn.top_k(q, "vec_id", "embedding", v, "vec_id", "embedding", 10, 64, True)
    ids = v.select(F.col("vec_id").cast("string").alias("v"), F.col("id").alias("node"))
    return n.join(ids.select(F.col("v").alias("query_id"), F.col("node").alias("src")), "query_id").join(ids.select(F.col("v").alias("id"), F.col("node").alias("dst")), "id").select("src", "dst", "rank", "score")


def _context(t: _Tables) -> DataFrame:
    return cut(community.community_context(*t.kept, t.communities))


def _kmeans(t: _Tables) -> DataFrame:
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    e = t.t("embeddings").select("vec_id", array_to_vector(F.col("embedding").cast("array<double>")).alias("features"))
    k = max(1, math.ceil(math.sqrt(e.count())))
    return KMeans(k=k, seed=42).fit(e).transform(e).select("vec_id", F.col("prediction").alias("cluster"))


def _chains(t: _Tables, ev: DataFrame) -> DataFrame:
    """Stand-in for the reasoning: each question's evidence texts of type S in order."""
    s = ev.where("type = 'S'").groupBy("uid").agg(F.array_sort(F.collect_list(F.struct("id", "text"))).alias("x"))
    return s.select("uid", F.array_join(F.transform("x", lambda r: r["text"]), " ").alias("chain"))


def _scores(t: _Tables) -> DataFrame:
    return evaluation.score(evaluation.predictions(t.t("eval_dump")))


def _align(t: _Tables) -> DataFrame:
    return retrieval.align(t.evidence, t.evidence_edges, _chains(t, t.evidence)).select("uid", "id", "p_reason")


def _graph_text(t: _Tables) -> DataFrame:
    return retrieval.textualize(t.evidence, t.evidence_edges)


def _gnn(t: _Tables) -> DataFrame:
    ev = t.evidence
    vec = knn.sparse_embed(ev.where("text is not null").select("id", "text").distinct(), "id", "text")
    x = ev.join(vec, "id").select("uid", "id", F.concat("vec", gnn.one_hot(F.col("type"))).alias("x"))
    return gnn.gnn_scores(x, t.evidence_edges, knn.sparse_embed(t.questions, "uid", "question").withColumnRenamed("vec", "q"))


def _token_count(t: _Tables) -> DataFrame:
    d = t.t("eval_dump").where("id is not null").select("id", F.concat_ws("", "prompt", F.lit("\n"), "answer").alias("x")).dropDuplicates(["id"])
    return token_counts(d, "id", "x")


_QUERIES: dict[str, Query] = {
    "p7_found": _q(lambda t: nested.found(t.t("musique"), t.t("eval_dump"))),
    "p7_nodes": _q(lambda t: nested.node_table(nested.graph_children(t.t("eval_dump")))),
    "p7_edges": _q(lambda t: nested.edge_table(nested.graph_children(t.t("eval_dump")))),
    "p7_paragraphs": _q(lambda t: nested.paragraph_table(t.t("musique"))),
    "p7_aliases": _q(lambda t: nested.alias_table(t.t("musique"))),
    "doc_concat": _q(_doc_concat),
    "sentence_split": _q(lambda t: documents.sentence_rows(t.t("documents")).select("doc_id", F.col("sent_no").cast("bigint").alias("sent_no"), "sentence")),
    "word_tokens": _q(lambda t: documents.word_counts(t.t("documents"))),
    "chunk": _q(lambda t: documents.chunk_rows(t.t("documents"))),
    "chunk_stats": _q(lambda t: documents.chunk_rows(t.t("documents")).select("doc_id", "chunk_no", "n_words")),
    "chunk_range": _q(lambda t: chunk_range(documents.chunk_rows(t.t("documents")), "chunk_no", 1, 3).select("doc_id", "chunk_no", "n_words")),
    "page_text": _q(_page_text),
    "entity_attributes": _q(lambda t: documents.entity_attributes(t.chunks)),
    "enrich": _q(lambda t: documents.enrich(documents.chunk_rows(t.t("documents"))).select("chunk_id", "summary", F.size("entities").alias("entities"), F.size("relations").alias("relations"))),
    "parse_entities": _q(lambda t: t.t("relations").where("raw is not null").select("rel_id", F.explode(parse_entities(F.col("raw"))).alias("entity")).distinct()),
    "parse_relations": _q(lambda t: t.t("relations").where("raw is not null").select("rel_id", F.explode(parse_relations(F.col("raw"))).alias("x")).select("rel_id", "x.*").distinct()),
    "entity_normalize": _q(lambda t: t.t("relations").where("source is not null").select("source", graph.normalize_name(F.col("source")).alias("key")).distinct()),
    "completeness": _q(lambda t: graph.incomplete(t.chunks).select("doc_id", F.array_join("missing_fields", ",").alias("missing"))),
    "retry_pending": _q(lambda t: documents.pending(graph.incomplete(t.chunks), t.t("relations").where("source is not null").select(F.col("chunk_id").alias("doc_id"))).select("doc_id")),
    "progress": _q(lambda t: documents.progress(t.chunks)),
    "nodes_g1": _q(lambda t: t.nodes.select("id", "type", "text")),
    "nodes_g1_promote": _q(lambda t: graph.nodes_g1(t.t("chunked_output"), "promote").select("id", "type", "text")),
    "edges_g1": _q(lambda t: t.edges.select("src", "dst", "label")),
    "simple_graph": _q(lambda t: graph.simple_graph(t.edges)),
    "snr_subgraph": _q(lambda t: t.snr[1].select("src", "dst", "label")),
    "out_degree": _q(lambda t: graph.out_degree(t.edges)),
    "g4_edges": _q(lambda t: graph.g4_edges(t.t("chunked_output"), t.kept[0]).select("src", "dst", "label")),
    "upsert_edges": _q(lambda t: graph.upsert_edges(t.kept[1], graph.g4_edges(t.t("chunked_output"), t.kept[0]))),
    "collapse_parallel": _q(lambda t: graph.collapse_parallel(t.edges).select("src", "dst", "label")),
    "graph_json": _q(lambda t: graph.to_json(t.nodes, t.edges).select("kind", "json")),
    "json_graph": _q(lambda t: graph.from_json(graph.to_json(t.nodes, t.edges))[1].select("src", "dst", "label")),
    "communities": _q(lambda t: community.communities(*t.snr)),
    "communities_modularity": _q(lambda t: community.modularity(t.snr[1], cut(community.communities(*t.snr)))),
    "components": _q(lambda t: community.components(*t.snr)),
    "label_propagation": _q(lambda t: t.communities),
    "modularity": _q(lambda t: community.modularity(t.snr[1], t.communities)),
    "community_context": _q(lambda t: _context(t).select("community", "kind", "text")),
    "ho_nodes": _q(lambda t: community.ho_nodes(community.titles(_context(t)))),
    "ho_edges": _q(lambda t: community.ho_edges(community.titles(_context(t)), t.kept[0], t.communities)),
    "kmeans": _q(_kmeans),
    "semantic_groups": _q(lambda t: graph.semantic_groups(t.t("embeddings").select(F.col("vec_id").alias("id"), F.col("label").alias("cluster"), (F.col("vec_id") % 7).alias("community")))),
    "knn": _q(lambda t: _embeddings_knn(t, 10, False)),
    "vector_topk": _q(lambda t: _embeddings_knn(t, 30, True)),
    "graph_knn": _q(lambda t: _graph_near(t).select("src", "dst", "score")),
    "g5_edges": _q(lambda t: t.final.edges.withColumn("weight", F.coalesce("weight", F.lit(1)))),
    "mean_pool": _q(lambda t: knn.mean_pool(t.t("embeddings"), "label", "embedding").select("label", F.col("pos").cast("bigint").alias("pos"), "mean")),
    "token_jaccard": _q(lambda t: retrieval.lexical_hits(t.t("musique").where("id is not null and question is not null").select(F.col("id").alias("uid"), "question").dropDuplicates(["uid"]), t.nodes)),
    "entry_points": _q(lambda t: t.entry.select("uid", "id", F.round("weight", 6).alias("weight"))),
    "ppr": _q(lambda t: t.scores.select("uid", "id", F.round("score", 6).alias("score"))),
    "topm_per_type": _q(lambda t: t.top.select("uid", "id", "type", "rank")),
    "induced_subgraph": _q(lambda t: t.evidence_edges.select("uid", "src", "dst", "label")),
    "reasoning_hits": _q(lambda t: retrieval.reasoning_hits(t.evidence, _chains(t, t.evidence)).select("uid", "id", F.col("hits").cast("bigint").alias("hits"), "p_reason")),
    "align": _q(_align),
    "answers": _q(lambda t: pipeline.answer(t.final, t.questions).select("uid", "prompt", "answer")),
    "gnn_features": _q(lambda t: t.final.nodes.select("id", gnn.one_hot(F.col("type")).alias("x"))),
    "g3_groups": _q(lambda t: graph.semantic_groups(pipeline.clusters(t.final.nodes).join(t.communities, "id"))),
    "graph_embedding": _q(_graph_embedding),
    "gnn_align": _q(_gnn),
    "textualize": _q(_graph_text),
    "prompt": _q(lambda t: retrieval.prompt(t.questions, _graph_text(t))),
    "reasoning_prompt": _q(lambda t: retrieval.reasoning_prompt(t.questions, t.evidence)),
    "qa_load": _q(lambda t: evaluation.load_questions(t.t("musique")).select("id", "question", F.array_join("answers", "|").alias("answers"), "context")),
    "normalize_answer": _q(lambda t: t.t("eval_dump").where("answer is not null").select("id", evaluation.normalize_answer(F.col("answer")).alias("normal")).distinct()),
    "qa_f1": _q(lambda t: _scores(t).select("uid", "gold", "f1", "precision", "recall").distinct()),
    "qa_exact": _q(lambda t: _scores(t).select("uid", "gold", "exact_match").distinct()),
    "qa_substring": _q(lambda t: _scores(t).select("uid", "gold", "accuracy").distinct()),
    "qa_best": _q(lambda t: evaluation.best(_scores(t))),
    "qa_summary": _q(lambda t: evaluation.summary(evaluation.best(_scores(t)))),
    "qa_samples": _q(lambda t: evaluation.load_questions(t.t("musique"), 50).select("id", "question")),
    "qa_bleu": _q(lambda t: evaluation.text_scores(evaluation.predictions(t.t("eval_dump"))).select("uid", "gold", *[c for c in evaluation.TEXT_METRICS if c.startswith("bleu")]).distinct()),
    "qa_meteor": _q(lambda t: evaluation.text_scores(evaluation.predictions(t.t("eval_dump"))).select("uid", "gold", "meteor").distinct()),
    "qa_rouge_l": _q(lambda t: evaluation.text_scores(evaluation.predictions(t.t("eval_dump"))).select("uid", "gold", "rouge_l").distinct()),
    "qa_full_summary": _q(lambda t: evaluation.full_summary(t.t("eval_dump"))),
    "qa_text_metrics": _q(lambda t: evaluation.text_scores(evaluation.predictions(t.t("eval_dump")))),
    "token_count": _q(_token_count),
    "answer_words": _q(lambda t: t.t("eval_dump").where("answer is not null").select("id", F.size(words(F.col("answer"))).alias("n")).distinct()),
}


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE)
