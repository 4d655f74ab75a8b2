"""Cutting lineage with tables written to the cluster's shared folder."""

from __future__ import annotations

import functools
import tempfile
import threading
import uuid
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.llm.textkit import mix

SIEVE = 1 << 25  # bits of a sieve

_of_thread = threading.local()


def made() -> list[str]:
    """Folders written by cut() in this thread and not yet deleted."""
    if not hasattr(_of_thread, "made"):
        _of_thread.made = []
    return _of_thread.made


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. Where that is unset, as in tests, a new temporary one for a master in this process;
    on a cluster it is an error, since executors do not see each other's disks."""
    conf = spark.sparkContext.getConf()
    path = conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError(f"spark.checkpoint.dir must name a folder that all executors of {master} share")
        path = "file://" + tempfile.mkdtemp(prefix="checkpoints-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def cut(df: DataFrame, name: str, rows: int | None = None, each: int = 200_000) -> DataFrame:
    """df written once as Parquet in the shared folder and read back: lost executors cost no recomputation.

    rows: how many rows the tasks that write read at most, where that is known. Then no more tasks write than are needed for `each` of
    them a task, so that small tables do not come in as many files as a shuffle has partitions; large ones' tasks stay as they are.
    """
    if rows is not None:
        df = df.coalesce(1 + rows // each)
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    made().append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _delete(spark: SparkSession, path: str) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    made().remove(path)


def _folders(df: DataFrame) -> set[str]:
    """Names of the folders that df's plan reads files of."""
    return {f.rsplit("/", 2)[-2] for f in df.inputFiles()}


def drop(*frames: DataFrame) -> None:
    """Deletes tables made by cut() that no later plan reads."""
    for df in frames:
        read = _folders(df)
        for path in [p for p in made() if p.rsplit("/", 1)[-1] in read]:
            _delete(df.sparkSession, path)


def tidy(f: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """f, after which the tables that it cut are deleted, but for those that its result reads."""

    @functools.wraps(f)
    def go(*args, **kwargs):
        before = set(made())
        out = f(*args, **kwargs)
        read = _folders(out)
        for path in [p for p in made() if p not in before and p.rsplit("/", 1)[-1] not in read]:
            _delete(out.sparkSession, path)
        return out

    return go


def _bits(ids: np.ndarray) -> np.ndarray:
    h = mix(ids.astype(np.int64).view(np.uint64) + np.uint64(SIEVE))
    return np.stack([h % np.uint64(SIEVE), (h >> np.uint64(32)) % np.uint64(SIEVE)])


def sieve(ids: DataFrame, column: str) -> np.ndarray:
    """A Bloom filter of the ids, of SIEVE bits whatever their number (4 MB to the driver and to each executor): with more of them
    than it has room for, it lets through more that a join must sort out, at last all."""

    def words(batches):
        for b in batches:
            at = np.unique(_bits(b.column(0).to_numpy()))
            word, n = np.unique(at >> np.uint64(6), return_inverse=True)
            bits = np.zeros(len(word), np.uint64)
            np.bitwise_or.at(bits, n, np.uint64(1) << (at & np.uint64(63)))
            yield pa.RecordBatch.from_arrays([pa.array(word.astype(np.int64)), pa.array(bits.view(np.int64))], ["word", "bits"])

    rows = ids.select(F.col(column).cast("long")).mapInArrow(words, "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
    out = np.zeros(SIEVE >> 6, np.uint64)
    out[rows.column("word").to_numpy()] = rows.column("bits").to_numpy().view(np.uint64)
    return out


def sifted(wanted: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Which ids may be among those of the sieve: all that are, and some others."""
    return np.all([(wanted[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1) == 1 for at in _bits(ids)], axis=0) if len(ids) else np.zeros(0, bool)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
