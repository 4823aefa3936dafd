"""What the operators of this subpackage share: words, folders, written tables."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from functools import lru_cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are runs of anything but the six ASCII white-space characters.
SPACES = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def words(text: Column) -> Column:
    """Words of a text as an array; null gives an empty array."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACES), "")


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value worked out once."""
    return F.transform(F.array(value), body)[0]


def held_out(doc_id: Column) -> Column:
    """True for the fifth of the ids on which nothing is learnt."""
    return F.coalesce(F.crc32(doc_id.cast("string")), F.lit(0)) % 5 == 0


@lru_cache(maxsize=1)
def local_folder() -> str:
    return "file://" + tempfile.mkdtemp(prefix="spark-filigree-")


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, which all executors share.

    Where that is unset, a local session, whose executor is the driver, gets a temporary folder;
    on a cluster it is an error, because executors can't read each other's disks.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder and spark.sparkContext.master.split("[")[0] == "local":
        folder = local_folder()
    if not folder:
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return folder.rstrip("/")


_SCRATCH: ContextVar[list[DataFrame] | None] = ContextVar("scratch", default=None)


@contextmanager
def scratch() -> Iterator[list[DataFrame]]:
    """Lists the tables that written() makes inside, so that all can be discarded once nothing reads them."""
    made: list[DataFrame] = []
    token = _SCRATCH.set(made)
    try:
        yield made
    finally:
        _SCRATCH.reset(token)


#: With this setting, shuffle files go as soon as the query that made them ends.
TIDY = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(df: DataFrame, compression: str = "zstd") -> DataFrame:
    """Write df as a table in the shared folder and read it back, which cuts its lineage.

    Nothing reads the query's shuffle files once the table is there, so they are removed then.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/filigree-{uuid.uuid4().hex}"
    before = spark.conf.get(TIDY, "false")
    spark.conf.set(TIDY, "true")
    try:
        df.write.option("compression", compression).parquet(path)
    finally:
        spark.conf.set(TIDY, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._filigree_path = path
    if (made := _SCRATCH.get()) is not None:
        made.append(out)
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables made by written() which nothing reads any more."""
    for df in tables:
        path = getattr(df, "_filigree_path", None)
        if path:
            jvm = df.sparkSession._jvm
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(p, True)
