"""What a job needs from the session: a shared folder, importable code, enough tasks."""

from __future__ import annotations

import hashlib
import os
import tempfile
import uuid
import zipfile
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

ROOT = Path(__file__).resolve().parents[2]


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir`` of the session.

    Only where the setting is absent (a local test) is a fresh local one used.
    The SparkContext is told about it, so that ``DataFrame.checkpoint`` works.
    """
    sc = spark.sparkContext
    where = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    current = sc._jsc.sc().getCheckpointDir()
    if where is None:
        if current.isDefined():
            return current.get()
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        where = tempfile.mkdtemp(prefix="loomgraph-")
    if not current.isDefined():
        sc.setCheckpointDir(where)
    return where


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared folder and drop its lineage (survives lost executors)."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def fingerprint(spark: SparkSession, paths: list[str]) -> str:
    """Digest of path, length and time of change of all files of some tables."""
    conf, found = spark.sparkContext._jsc.hadoopConfiguration(), []
    for path in paths:
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        files = p.getFileSystem(conf).listFiles(p, True)
        while files.hasNext():
            f = files.next()
            found.append(f"{f.getPath()} {f.getLen()} {f.getModificationTime()}")
    return hashlib.md5("\n".join(sorted(found)).encode()).hexdigest()


def stored(spark: SparkSession, name: str, key: str, build: Callable[[], DataFrame]) -> DataFrame:
    """A table of the store in the shared folder: read where it is complete, else built and written.

    ``key`` names the state of the inputs (``fingerprint``), so a changed input gives
    another table. The table is written beside its place and then renamed, so readers
    never see a part of it; of two writers one wins.
    """
    where = f"{shared_dir(spark)}/loomgraph-store/{key}/{name}"
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    fs = path(where).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(path(f"{where}/_SUCCESS")):
        new = f"{where}-{uuid.uuid4().hex}"
        build().write.parquet(new)
        if not fs.rename(path(new), path(where)) or fs.exists(path(f"{where}/{path(new).getName()}")):
            fs.delete(path(f"{where}/{path(new).getName()}"), True)  # another writer was first
            fs.delete(path(new), True)
    return spark.read.parquet(where)


def ship(spark: SparkSession) -> None:
    """Make this package importable in Python workers that do not see its folder."""
    sc = spark.sparkContext
    seen = os.environ.get("PYTHONPATH", "").split(os.pathsep)
    if str(ROOT) in seen or sc.master.startswith("local[") and Path.cwd() == ROOT:
        return
    if getattr(sc, "_loomgraph_shipped", False):
        return
    out = Path(tempfile.mkdtemp(prefix="loomgraph-zip-")) / "loomgraph.zip"  # the driver serves it from here
    with zipfile.ZipFile(out, "w") as z:
        for p in (ROOT / "loomgraph").rglob("*.py"):
            z.write(p, p.relative_to(ROOT))
    sc.addPyFile(str(out))
    sc._loomgraph_shipped = True


#: Tables above this size stay as they are split, however many cores there are.
SPREAD_BYTES = 4 << 30


def spread(df: DataFrame) -> DataFrame:
    """Round-robin a small input of few partitions over all cores; large inputs keep their splits, so their texts are not shuffled."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() * 2 > cores or int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) > SPREAD_BYTES:
        return df
    return df.repartition(cores)
