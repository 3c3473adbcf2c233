"""Incremental ingest: documents arrive as files, are chunked, enriched and merged into the graph."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from loomgraph.operators.documents import OfflineModel, chunk_rows, enrich, pending
from loomgraph.operators.graph import edges_g1, nodes_g1


def ingest(spark: SparkSession, source: str, schema: str, out: str, checkpoint: str, model: type = OfflineModel, files_per_batch: int = 8, size: int = 400, overlap: int = 40) -> StreamingQuery:
    """Chunk and enrich new parquet files of ``source`` into ``out``/chunks, one folder per micro-batch.

    The batch's part of the graph goes to ``out``/nodes and ``out``/edges; ``merged_graph``
    puts the parts together. A batch that runs again overwrites its own folders, so each
    document counts once; the checkpoint holds what has been read. Returns the query,
    which ends when all present files are done.
    """

    def batch(df: DataFrame, n: int) -> None:
        c = enrich(chunk_rows(df, size=size, overlap=overlap), model)
        c.write.mode("overwrite").parquet(f"{out}/chunks/batch={n}")
        c = df.sparkSession.read.parquet(f"{out}/chunks/batch={n}")
        c = c.select(F.col("chunk_id").alias("id"), F.lit(None).cast("bigint").alias("book_id"), "chunk_no", "text", "summary", "entities", "relations")
        nodes_g1(c).write.mode("overwrite").parquet(f"{out}/nodes/batch={n}")
        edges_g1(c).write.mode("overwrite").parquet(f"{out}/edges/batch={n}")

    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(source)
    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def merged_graph(spark: SparkSession, out: str) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of all batches: the first mention of a node by batch and order wins; edges are a multiset.

    The parts stay as they are, so a batch costs what it brings, whatever the size of the graph.
    """
    n = spark.read.parquet(f"{out}/nodes")
    first = n.groupBy("id").agg(F.min(F.struct("batch", "seq", "type", "text")).alias("x"))
    return first.select("id", "x.type", "x.text", "x.seq"), spark.read.parquet(f"{out}/edges").drop("batch")


def retry(todo: DataFrame, attempt, rounds: int = 3) -> tuple[DataFrame, DataFrame]:
    """(done, left): ``attempt`` (rows -> rows with doc_id) is run on what is still pending, ``rounds`` times at most."""
    done = attempt(todo).persist()
    for _ in range(rounds - 1):
        rest = pending(todo, done)
        if rest.isEmpty():
            break
        done = done.unionByName(attempt(rest)).persist()
    return done, pending(todo, done)


def windowed_arrivals(events: DataFrame, late: str = "10 minutes", width: str = "5 minutes") -> DataFrame:
    """(window, event_type, n): arrivals per window, later rows than ``late`` dropped by the watermark."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"))
