"""Exact top-k search of stated query vectors against all vectors, in blocks."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.functions.text import words
from loomgraph.plans.runtime import ship

BLOCK = 2048


def _blocks(df: DataFrame, key: str, vec: str, dim: int, parts: int) -> DataFrame:
    """(ids, flat): about ``BLOCK`` unit vectors a row; unusable vectors are left out."""
    ok = df.where(F.col(key).isNotNull() & (F.size(vec) == dim) & ~F.exists(vec, lambda x: x.isNull() | F.isnan(x)))
    rows = ok.select(F.col(key).cast("string").alias("id"), F.col(vec).cast("array<double>").alias("v"))

    def run(key_, t):
        x = t.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
        n = np.sqrt((x * x).sum(1))
        keep = n > 0
        x = x[keep] / n[keep, None]
        ids = [i for i, k in zip(t.column("id").to_pylist(), keep) if k]
        return pa.table({"ids": pa.array([ids], pa.list_(pa.string())), "flat": pa.array([x.tobytes()], pa.binary())})

    g = rows.withColumn("b", F.pmod(F.xxhash64("id"), F.lit(parts)))
    return g.groupBy("b").applyInArrow(run, "ids array<string>, flat binary")


def build_index(data: DataFrame, key: str, vec: str, dim: int) -> DataFrame:
    """(ids, flat): all usable vectors of ``data`` in blocks of unit vectors; what ``search`` reads."""
    ship(data.sparkSession)
    return _blocks(data, key, vec, dim, max(1, -(-data.count() // BLOCK)))


def save_index(index: DataFrame, path: str) -> None:
    """Write an index as parquet, so that later sessions need not embed or normalise again."""
    index.write.mode("overwrite").parquet(path)


def load_index(spark, path: str) -> DataFrame:
    return spark.read.parquet(path)


def top_k(queries: DataFrame, q_key: str, q_vec: str, data: DataFrame, key: str, vec: str, k: int, dim: int, skip_self: bool = False) -> DataFrame:
    """(query_id, id, rank, score): the ``k`` nearest by cosine (rounded to 6 decimals, ties to the smaller id as text).

    Blocks of queries meet blocks of data; each meeting keeps ``k`` per query, so what
    is shuffled is queries x blocks x k, never queries x rows.
    """
    return search(build_index(data, key, vec, dim), queries, q_key, q_vec, k, dim, skip_self)


def search(index: DataFrame, queries: DataFrame, q_key: str, q_vec: str, k: int, dim: int, skip_self: bool = False) -> DataFrame:
    """The same against an index that is built already."""
    ship(index.sparkSession)
    d, q = index, build_index(queries, q_key, q_vec, dim).select(F.col("ids").alias("qids"), F.col("flat").alias("qflat"))
    schema = pa.schema([("query_id", pa.string()), ("id", pa.string()), ("score", pa.float64())])

    def run(batches):
        for b in batches:
            out = ([], [], [])
            for ids, flat, qids, qflat in zip(*(c.to_pylist() for c in b.columns)):
                if not ids or not qids:
                    continue
                x, y = np.frombuffer(flat).reshape(-1, dim), np.frombuffer(qflat).reshape(-1, dim)
                names = np.array(ids)
                rank_of = np.argsort(np.argsort(names))
                s = np.round(y @ x.T, 6) + 0.0
                for r, name in enumerate(qids):
                    if skip_self:
                        s[r, names == name] = -9.0
                    near = np.lexsort((rank_of, -s[r]))[:k]
                    near = near[s[r, near] > -2]
                    out[0].extend([name] * len(near))
                    out[1].extend(names[near].tolist())
                    out[2].extend(s[r, near].tolist())
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, schema)], schema=schema)

    got = d.crossJoin(q).select("ids", "flat", "qids", "qflat").mapInArrow(run, "query_id string, id string, score double")  # blocks x blocks
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return got.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "id", "rank", "score")


def hash_embed(text, dim: int = 384):
    """Deterministic stand-in for a sentence embedding: word counts hashed into ``dim`` buckets."""
    bucket = F.transform(words(F.lower(text)), lambda t: (F.conv(F.substring(F.md5(t), 1, 8), 16, 10).cast("bigint") % dim).cast("int"))
    return F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: F.size(F.filter(bucket, lambda b: b == i)).cast("double"))


def sparse_embed(df: DataFrame, key: str, text: str, dim: int = 384) -> DataFrame:
    """(key, vec): the same as a dense array, by explode and count."""
    t = df.select(key, F.explode(words(F.lower(F.col(text)))).alias("w"))
    t = t.select(key, (F.conv(F.substring(F.md5("w"), 1, 8), 16, 10).cast("bigint") % dim).cast("int").alias("b")).groupBy(key, "b").agg(F.count("*").cast("double").alias("n"))
    m = t.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("b", "n"))).alias("m"))  # dim entries at most
    return m.select(key, F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: F.coalesce(F.element_at("m", i), F.lit(0.0))).alias("vec"))


def mean_pool(df: DataFrame, group: str, vec: str) -> DataFrame:
    """(group, pos, mean): element-wise mean of the vectors of a group."""
    return df.select(group, F.posexplode(vec).alias("pos", "x")).where("x is not null and not isnan(x)").groupBy(group, "pos").agg(F.round(F.avg(F.col("x").cast("double")), 6).alias("mean"))
