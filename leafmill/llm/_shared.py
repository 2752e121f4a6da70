"""Helpers that several operators of this subpackage share."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_written: list[tuple[SparkSession, str]] = []
_own_folder: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors see: ``spark.checkpoint.dir``, or where that is unset and the driver is the only machine one of our own."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if spark.sparkContext.master.split("[")[0] != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not _own_folder:
        _own_folder.append(tempfile.mkdtemp(prefix="leafmill-"))
    return f"file://{_own_folder[0]}"


def _delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it again.

    It cuts the lineage: what follows depends on files that outlive any
    executor. One computation, compressed columns; the files go at exit.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/leafmill/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _written.append((spark, path))
    out = spark.read.schema(df.schema).parquet(path)
    out._leafmill_path = path
    return out


def discard(df: DataFrame) -> None:
    """Delete what ``materialize`` wrote for ``df``, once nothing reads it any more."""
    path = getattr(df, "_leafmill_path", None)
    if path is not None:
        _delete(df.sparkSession, path)
        _written[:] = [x for x in _written if x[1] != path]


@atexit.register
def _clean() -> None:
    for spark, path in _written:
        try:
            _delete(spark, path)
        except Exception:  # noqa: BLE001 - the session may have ended before
            return


#: Bits of the filter that ``marked`` broadcasts: 2 MB, whatever the number of keys.
FILTER_BITS, _BUCKET = 1 << 24, 1 << 15


def marked(df: DataFrame, key: str, keys: DataFrame) -> DataFrame:
    """``df`` with ``_marked``: false only for rows whose ``key`` (a hash) isn't in the one column of ``keys``.

    A bitmap of fixed size goes to all tasks, so rows that a join would drop
    needn't be shuffled for it. Other rows may be marked by chance, the more the
    more keys there are; so the join itself must follow.
    """
    bit = lambda c: F.pmod(F.col(c), F.lit(FILTER_BITS))
    own = keys.toDF("_k").select(bit("_k").alias("_bit"))
    bits = own.groupBy(F.floor(F.col("_bit") / _BUCKET).cast("int").alias("_bucket")).agg(F.bitmap_construct_agg(F.col("_bit") % _BUCKET).alias("_bits"))
    at = bit(key) % _BUCKET
    byte = F.conv(F.hex(F.substring("_bits", (F.floor(at / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    found = df.withColumn("_bucket", F.floor(bit(key) / _BUCKET).cast("int")).join(F.broadcast(bits), "_bucket", "left")
    return found.withColumn("_marked", F.coalesce(F.getbit(byte, (at % 8).cast("int")) == 1, F.lit(False))).drop("_bucket", "_bits")


def apart(docs: DataFrame) -> DataFrame:
    """``(doc_id, text, rest)``: all columns but the text in one struct, so that no column's name can clash with an operator's."""
    rest = [F.col(f"`{c}`") for c in docs.columns if c != "text"]
    return docs.select(F.col("doc_id").alias("doc_id"), F.col("text").cast("string").alias("text"), F.struct(*rest).alias("rest"))


def together(df: DataFrame, columns: list[str]) -> DataFrame:
    """The inverse: the columns that ``apart`` took, with the texts of ``df``."""
    return df.select(*(F.col("text") if c == "text" else F.col("rest").getField(c).alias(c) for c in columns))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(column: str = "text"):
    """The text, null as empty."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def unsigned_crc32(column):
    return F.crc32(F.encode(column, "UTF-8")).cast("long")
