"""Queries of the training-data operators: ``name -> f(spark, sf_dir)``, and SQL where SQL can express one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.llm import foldcopies, mixing, packing, pairs, pieces, scans, sentences, truncation, vectors
from loomgraph.sources.tables import table


def _unscanned(chunks: DataFrame) -> DataFrame:
    """The chunks without page noise: the model of sentence ends is learned from them alone."""
    return chunks.where("origin is null or origin <> 'scan'")


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = _unscanned(table(spark, sf_dir, "chunked_output"))
    return sentences.split_sentences(chunks, sentences.learn(chunks))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairs.broken_pairs(table(spark, sf_dir, "eval_dump"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.nearest(table(spark, sf_dir, "graph_embeddings"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scans.noisy_lines(table(spark, sf_dir, "chunked_output"), table(spark, sf_dir, "books"))


def p4_repaired(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scans.repaired(table(spark, sf_dir, "chunked_output"), table(spark, sf_dir, "books"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = table(spark, sf_dir, "chunked_output")
    return pieces.cut_levels(chunks, sentences.learn(_unscanned(chunks)))


def p5_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = table(spark, sf_dir, "chunked_output")
    return pieces.cut_pieces(chunks, sentences.learn(_unscanned(chunks)))


def _p6(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    chunks = foldcopies.group_copies(foldcopies.hash_lists(table(spark, sf_dir, "chunked_output"), "id", "entities"), numeric=False)
    triples = foldcopies.group_copies(foldcopies.hash_triples(table(spark, sf_dir, "relations"), "rel_id", ["source", "relationship", "destination"], "raw"), numeric=True)
    return chunks, triples


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks, triples = _p6(spark, sf_dir)
    return chunks.select(F.lit("chunked_output").alias("tbl"), "rec_id", "keep_id").unionByName(triples.select(F.lit("relations").alias("tbl"), "rec_id", "keep_id"))


def p6_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p6_found(spark, sf_dir).groupBy("tbl", "keep_id").agg(F.count("*").alias("copies"))


def p8_packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def p8_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.container_fill(p8_packed(spark, sf_dir))


def p9_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"), weight=mixing.RARITY)


def p9_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.shares(p9_mix(spark, sf_dir), table(spark, sf_dir, "mix_targets"))


def _abbreviations(docs: DataFrame) -> frozenset:
    """Abbreviations that hardly ever end a sentence, learned from all documents."""
    model = sentences.learn(docs, ends_only=True)
    return frozenset(a for m in model.values() for a, p in m["ends"].items() if p < 0.3 and len(a) > 1)


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return truncation.cut_documents(docs, _abbreviations(docs)).select("doc_id")


def p10_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return truncation.truncation_rates(docs, _abbreviations(docs))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "p1_found": p1_found,
        "p2_found": p2_found,
        "p3_found": p3_found,
        "p4_found": p4_found,
        "p4_repaired": p4_repaired,
        "p5_found": p5_found,
        "p5_pieces": p5_pieces,
        "p6_found": p6_found,
        "p6_copies": p6_copies,
        "p8_packed": p8_packed,
        "p8_containers": p8_containers,
        "p9_mix": p9_mix,
        "p9_shares": p9_shares,
        "p10_found": p10_found,
        "p10_rates": p10_rates,
    }


def _field(name: str) -> str:
    """SQL of one field of raw model output: quoted, or up to a separator."""
    at = f"(?i)\\b{name}[\"'']?\\s*[:=]\\s*"
    part = lambda body: f"nullif(regexp_extract(raw, '{at}{body}', 1), '')"
    return f"coalesce({part(chr(34) + '([^' + chr(34) + ']*)' + chr(34))}, {part(chr(39) * 2 + '([^' + chr(39) * 2 + ']*)' + chr(39) * 2)}, {part('([^;,}' + chr(34) + chr(39) * 2 + chr(92) + 'n]+)')})"


def _same(c: str) -> str:
    return f"regexp_replace(lower({c}), '[^\\p{{L}}\\p{{N}}\\p{{M}}]', '', 'g')"


_P6 = f"""WITH r AS (SELECT rel_id, any_value(raw) AS raw, any_value(source) AS s0, any_value(relationship) AS p0, any_value(destination) AS d0 FROM relations WHERE rel_id IS NOT NULL GROUP BY rel_id),
t AS (SELECT rel_id, CASE WHEN u THEN {_field("source")} ELSE s0 END AS s, CASE WHEN u THEN {_field("relationship")} ELSE p0 END AS p, CASE WHEN u THEN {_field("destination")} ELSE d0 END AS d
    FROM (SELECT *, s0 IS NULL AND p0 IS NULL AND d0 IS NULL AS u FROM r)),
k AS (SELECT rel_id, {_same("s")} AS a, {_same("p")} AS b, {_same("d")} AS c FROM t),
kr AS (SELECT rel_id::VARCHAR AS rec_id, min(rel_id) OVER w AS keep, count(*) OVER w AS n FROM k WHERE a <> '' AND b <> '' AND c <> '' WINDOW w AS (PARTITION BY a, b, c)),
e AS (SELECT id, list_sort(list_distinct(list_filter(list_transform(any_value(entities), lambda x: {_same("x")}), lambda x: coalesce(x, '') <> ''))) AS a FROM chunked_output WHERE id IS NOT NULL GROUP BY id),
ke AS (SELECT id AS rec_id, min(id) OVER w AS keep, count(*) OVER w AS n FROM e WHERE len(a) > 0 WINDOW w AS (PARTITION BY a)),
f AS (SELECT 'relations' AS tbl, rec_id, keep::VARCHAR AS keep_id FROM kr WHERE n > 1 UNION ALL SELECT 'chunked_output', rec_id, keep FROM ke WHERE n > 1)
"""


def oracle_sql() -> dict[str, str]:
    return {
        "p6_found": _P6 + "SELECT tbl, rec_id, keep_id FROM f",
        "p6_copies": _P6 + "SELECT tbl, keep_id, count(*) AS copies FROM f GROUP BY tbl, keep_id",
    }
