"""Sources and sinks: PDF files, JSON lines, JSON maps, graphs, results."""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.operators.graph import collapse_parallel
from loomgraph.plans.runtime import ship

CHUNK_SCHEMA = "id STRING, doc_id STRING, text STRING, entities ARRAY<STRING>, summary STRING, relations ARRAY<STRUCT<Source: STRING, Relationship: STRING, Destination: STRING>>"
QA_SCHEMA = "id STRING, question STRING, answer STRING, answer_aliases ARRAY<STRING>, answerable BOOLEAN, paragraphs ARRAY<STRUCT<idx: INT, title: STRING, paragraph_text: STRING, is_supporting: BOOLEAN>>"
COMMUNITY_SCHEMA = "MAP<STRING, STRUCT<summary_texts: ARRAY<STRING>, relation_texts: ARRAY<STRING>, HL_summary: STRING, title: STRING>>"


def read_pdf(spark: SparkSession, path: str, parser: Callable[[bytes], list[str]] | None = None) -> DataFrame:
    """(path, page_no, text) of a PDF file or of all PDF files of a folder (any letter case).

    ``parser`` turns a file's bytes into the texts of its pages; without it an installed
    PDF library is used. Anything that is neither a PDF nor a folder raises ValueError.
    """
    p, fs = _file_system(spark, path)
    if not fs.exists(p) or not (fs.getFileStatus(p).isDirectory() or path.lower().endswith(".pdf")):
        raise ValueError(f"neither a PDF file nor a folder: {path}")
    if parser is None:
        try:
            import fitz
        except ImportError as e:
            raise RuntimeError("no PDF library is installed; give a parser") from e
        parser = lambda data: [page.get_text() for page in fitz.open(stream=data, filetype="pdf")]
    ship(spark)
    schema = pa.schema([("path", pa.string()), ("page_no", pa.int64()), ("text", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(f, n, t) for f, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) for n, t in enumerate(parser(data))]
            yield pa.RecordBatch.from_arrays([pa.array(c, x.type) for c, x in zip(zip(*rows), schema)] if rows else [pa.array([], x.type) for x in schema], schema=schema)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.[pP][dD][fF]").load(path)
    return files.select("path", "content").mapInArrow(run, "path string, page_no bigint, text string")


def read_chunks(spark: SparkSession, path: str) -> DataFrame:
    """Chunk file in JSON lines; the id may be called ``doc_id``, a blank one counts as missing."""
    c = spark.read.schema(CHUNK_SCHEMA).json(path)
    return c.withColumn("id", F.coalesce(F.nullif("id", F.lit("")), F.nullif("doc_id", F.lit("")))).drop("doc_id")


def read_qa(spark: SparkSession, path: str) -> DataFrame:
    """Question set in JSON lines."""
    return spark.read.schema(QA_SCHEMA).json(path)


def chunk_range(chunks: DataFrame, order: str, start: int = 0, end: int | None = None) -> DataFrame:
    """Rows with start <= order < end; pushed down to the scan."""
    c = chunks.where(F.col(order) >= start)
    return c if end is None else c.where(F.col(order) < end)


def read_community_map(spark: SparkSession, path: str) -> DataFrame:
    """(community, summary_texts, relation_texts, HL_summary, title) of a JSON object keyed by community."""
    m = spark.read.option("wholetext", True).text(path).select(F.from_json("value", COMMUNITY_SCHEMA).alias("m"))
    return m.select(F.explode("m").alias("community", "x")).select("community", "x.*")


def write_community_map(context: DataFrame, texts: DataFrame, path: str) -> None:
    """One JSON line per community: community, summary_texts, relation_texts, HL_summary, title (NULL where not made yet).

    ``context`` is (community, kind, text, seq), ``texts`` (community, hl_summary, title).
    A community's texts stand in one record, as in the map.
    """
    of = lambda kind: F.transform(F.array_sort(F.collect_list(F.when(F.col("kind") == kind, F.struct("seq", "text")))), lambda x: x["text"])
    rows = context.groupBy("community").agg(of("summary").alias("summary_texts"), of("relation").alias("relation_texts"))
    write_json(rows.join(texts.select("community", F.col("hl_summary").alias("HL_summary"), "title"), "community", "left"), path)


GRAPH_SCHEMA = "STRUCT<nodes: ARRAY<STRUCT<id: STRING, type: STRING, text: STRING, community: STRING>>, edges: ARRAY<STRUCT<source: STRING, target: STRING, label: STRING, weight: INT>>>"
DUMP_SCHEMA = "MAP<STRING, STRUCT<id: STRING, query: STRING, answers: ARRAY<ARRAY<STRING>>, G_raw: STRING, reasoning_chain: STRING, G_aligned: STRING, prompt: STRING, answer: STRING>>"


def read_graph_json(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of graph files, one JSON object each; a pair's last edge wins; an object without nodes raises ValueError."""
    g = spark.read.option("wholetext", True).text(path).select(F.from_json("value", GRAPH_SCHEMA).alias("g"))
    if not g.where("g.nodes is null").isEmpty():
        raise ValueError(f"a graph without nodes: {path}")
    nodes = g.select(F.explode("g.nodes").alias("x")).select("x.*").dropDuplicates(["id"])
    e = g.select(F.posexplode("g.edges").alias("seq", "x")).select(F.col("x.source").alias("src"), F.col("x.target").alias("dst"), "x.label", "x.weight", "seq")
    return nodes, collapse_parallel(e)


def read_eval_dump(spark: SparkSession, path: str) -> DataFrame:
    """(id, query, answers, g_raw, reasoning_chain, g_aligned, prompt, answer) of a JSON object keyed by id; graphs stay JSON text."""
    m = spark.read.option("wholetext", True).text(path).select(F.from_json("value", DUMP_SCHEMA).alias("m"))
    x = m.select(F.explode("m").alias("key", "x"))
    return x.select(F.coalesce("x.id", "key").alias("id"), "x.query", "x.answers", F.col("x.G_raw").alias("g_raw"), "x.reasoning_chain", F.col("x.G_aligned").alias("g_aligned"), "x.prompt", "x.answer")


def save_progress(spark: SparkSession, path: str, task: str, processed: int, left: DataFrame) -> None:
    """State of one task: a row with the count, and a row per unprocessed element (doc_id)."""
    done = spark.createDataFrame([(task, processed, None)], "task string, processed bigint, doc_id string")
    done.unionByName(left.select(F.lit(task).alias("task"), F.lit(None).cast("bigint").alias("processed"), "doc_id")).write.mode("overwrite").parquet(f"{path}/task={task}")


def load_progress(spark: SparkSession, path: str, task: str) -> tuple[int, DataFrame]:
    """(processed, unprocessed doc_ids); zero and none where nothing was saved."""
    where = f"{path}/task={task}"
    if not _exists(spark, where):
        return 0, spark.createDataFrame([], "doc_id string")
    rows = spark.read.parquet(where)
    return rows.agg(F.max("processed")).first()[0] or 0, rows.where("doc_id is not null").select("doc_id")


def delete_progress(spark: SparkSession, path: str, task: str) -> None:
    p, fs = _file_system(spark, f"{path}/task={task}")
    fs.delete(p, True)


def _file_system(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _exists(spark: SparkSession, path: str) -> bool:
    p, fs = _file_system(spark, path)
    return fs.exists(p)


def settings(spark: SparkSession, **defaults: str) -> dict[str, str]:
    """Settings of a job: ``spark.loomgraph.NAME`` of the session, else the environment's ``LOOMGRAPH_NAME``, else the default."""
    return {k: spark.conf.get(f"spark.loomgraph.{k}", os.environ.get(f"LOOMGRAPH_{k.upper()}", d)) for k, d in defaults.items()}


def join_pages(pages: DataFrame) -> DataFrame:
    """(doc, text): the page texts of each file without separator, in page order. The pages of one file stand in one row, as its text must."""
    p = pages.groupBy(F.col("path").alias("doc")).agg(F.array_sort(F.collect_list(F.struct("page_no", "text"))).alias("x"))
    return p.select("doc", F.array_join(F.transform("x", lambda r: F.coalesce(r["text"], F.lit(""))), "").alias("text"))


def write_graph(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """Nodes, partitioned by type, and edges as parquet."""
    nodes.write.mode("overwrite").partitionBy("type").parquet(f"{path}/nodes")
    edges.write.mode("overwrite").parquet(f"{path}/edges")


def read_graph(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.parquet(f"{path}/nodes"), spark.read.parquet(f"{path}/edges")


def write_json(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """JSON lines in one write per stage (mode 'append' for logs)."""
    df.write.mode(mode).json(path)


def write_if_any(df: DataFrame, path: str) -> bool:
    """Write only a non-empty result; tells whether it was."""
    if df.isEmpty():
        return False
    write_json(df, path)
    return True


def insert_absent(old: DataFrame, new: DataFrame, key: str = "id") -> DataFrame:
    """Rows of ``old`` and those of ``new`` whose key it lacks."""
    return old.unionByName(new.join(old.select(key), key, "left_anti"), allowMissingColumns=True)


def push(df: DataFrame, sink: Callable[[Iterator], None]) -> None:
    """Hand every partition's rows to ``sink`` (a client of a graph store); it must be idempotent, as tasks may run again."""
    df.foreachPartition(sink)
