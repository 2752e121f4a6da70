"""The store of documents, pages and settings: reads, changes as new tables, schema checks.

Every change is a function from tables to tables; ``Store`` keeps them as Parquet
in a folder, each version in a folder of its own that a pointer names, so a
reader sees one whole version.
"""

from __future__ import annotations

import uuid
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from leafmill import schemas
from leafmill.functions.dates import default_title
from leafmill.functions.text import has_text, slug

# Settings that hold unless stored otherwise, as JSON.
DEFAULT_SETTINGS = {
    "ocrLangs": '["eng","hin"]',
    "installedLangs": '["eng"]',
    "defaultFilter": '"auto"',
    "autoCapture": "true",
    "autoOcr": "true",
    "pdfPageSize": '"fit"',
    "jpegQuality": "0.86",
    "maxDimension": "2400",
    "gridView": "true",
    "translateProvider": '"mymemory"',
    "translateTarget": '"en"',
    "translateConsent": "false",
    "translateUrl": '""',
    "translateKey": '""',
    "translateEmail": '""',
}


def list_documents(documents: DataFrame) -> DataFrame:
    return documents.orderBy(F.desc("updatedAt"), "id")


def get(rows: DataFrame, key: str, value) -> DataFrame:
    return rows.where(F.col(key) == F.lit(value))


def get_pages(pages: DataFrame, doc_id) -> DataFrame:
    return pages.where(F.col("docId") == F.lit(doc_id)).orderBy("index")


def overlay_settings(stored: DataFrame, defaults: DataFrame) -> DataFrame:
    """``(key, value)``: defaults, overlaid by what is stored, unknown keys included."""
    own = stored.select("key", F.col("value").alias("own"), F.lit(True).alias("is_stored"))
    joined = defaults.join(own, "key", "full_outer")
    return joined.select("key", F.when(F.col("is_stored"), F.col("own")).otherwise(F.col("value")).alias("value"))


def default_settings(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(DEFAULT_SETTINGS.items()), schemas.SETTINGS)


def create_document(documents: DataFrame, id: str, at: datetime, title: str | None = None) -> DataFrame:
    spark = documents.sparkSession
    when = F.lit(at).cast("timestamp")
    row = spark.range(1).select(
        F.lit(id).alias("id"), F.coalesce(F.nullif(F.lit(title).cast("string"), F.lit("")), default_title(when)).alias("title"), when.alias("createdAt"), when.alias("updatedAt"),
        F.lit(0).alias("pageCount"), F.array().cast("array<string>").alias("tags"), F.array().cast("array<string>").alias("langs"),
    )
    return documents.unionByName(row)


def touched(documents: DataFrame, ids: DataFrame, at: Column) -> DataFrame:
    """``updatedAt`` of the documents in ``ids(docId)`` as ``at``."""
    marks = ids.select(F.col("docId").alias("_d")).distinct().withColumn("_t", F.lit(True))
    joined = documents.join(marks, F.col("id") == F.col("_d"), "left")
    return joined.withColumn("updatedAt", F.when(F.col("_t"), at).otherwise(F.col("updatedAt"))).select(*documents.columns)


def recounted(documents: DataFrame, pages: DataFrame) -> DataFrame:
    counts = pages.groupBy("docId").agg(F.count("*").cast("int").alias("_n")).withColumnRenamed("docId", "_d")
    return documents.join(counts, F.col("id") == F.col("_d"), "left").withColumn("pageCount", F.coalesce("_n", F.lit(0))).select(*documents.columns)


def add_pages(pages: DataFrame, more: DataFrame) -> DataFrame:
    """``more`` behind each document's pages, in the order of its own ``index``."""
    last = pages.groupBy("docId").agg(F.count("*").alias("_n"))
    place = F.row_number().over(Window.partitionBy("docId").orderBy("index", "id")) - 1
    new = more.withColumn("_r", place).join(last, "docId", "left").withColumn("index", (F.coalesce("_n", F.lit(0)) + F.col("_r")).cast("int"))
    missing = [f for f in pages.schema.fields if f.name not in more.columns]
    return pages.unionByName(new.withColumns({f.name: F.lit(None).cast(f.dataType) for f in missing}).select(*pages.columns))


def update(rows: DataFrame, patch: DataFrame, key: str = "id") -> DataFrame:
    """Columns of ``patch`` in place of those of the rows with the same key, where they aren't null; unknown keys do nothing."""
    names = [c for c in patch.columns if c != key]
    new = patch.select(F.col(key).alias("_key"), *(F.col(c).alias(f"_new_{c}") for c in names))
    joined = rows.join(new, F.col(key) == F.col("_key"), "left")
    return joined.select(*(F.coalesce(f"_new_{c}", c).alias(c) if c in names else F.col(c) for c in rows.columns))


def delete_documents(documents: DataFrame, pages: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both tables without the documents in ``ids(id)`` and their pages."""
    gone = ids.select("id").distinct()
    return documents.join(gone, "id", "left_anti"), pages.join(gone.withColumnRenamed("id", "docId"), "docId", "left_anti")


def renumbered(pages: DataFrame, parent: str = "docId", index: str = "index") -> DataFrame:
    """``index`` from 0 without gaps."""
    order = Window.partitionBy(parent).orderBy(index)
    return pages.withColumn(index, (F.row_number().over(order) - 1).cast(pages.schema[index].dataType))


def delete_pages(pages: DataFrame, ids: DataFrame) -> DataFrame:
    return renumbered(pages.join(ids.select("id").distinct(), "id", "left_anti"))


def reorder_pages(pages: DataFrame, order: DataFrame) -> DataFrame:
    """Pages take the places that the lists in ``order(docId, ids)`` give them; others keep theirs, unknown ids do nothing."""
    places = order.select(F.col("docId").alias("_d"), F.posexplode("ids").alias("_i", "_p"))
    joined = pages.join(places, (F.col("docId") == F.col("_d")) & (F.col("id") == F.col("_p")), "left")
    return joined.withColumn("index", F.coalesce("_i", "index")).select(*pages.columns)


def set_settings(stored: DataFrame, changes: DataFrame) -> DataFrame:
    """``changes(key, value, version)`` put over what is stored; the highest version of a key counts."""
    every = stored.select("key", "value", F.lit(-1).cast("long").alias("version")).unionByName(changes.select("key", "value", F.col("version").cast("long").alias("version")))
    return every.groupBy("key").agg(F.max_by("value", "version").alias("value"))


def export_text(pages: DataFrame) -> DataFrame:
    """``(docId, text)``: the texts of the pages that have any, if only blanks, with a blank line between. No row where no page has one."""
    own = pages.where(F.coalesce("text", F.lit("")) != "")
    return own.groupBy("docId").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("index", "text"))), lambda s: s["text"]), "\n\n").alias("text"))


def read_status(pages: DataFrame) -> DataFrame:
    """``(docId, pages, read, any_read, all_read)``; a page of white space alone, or of no text, isn't read."""
    has = has_text("text")
    return pages.groupBy("docId").agg(F.count("*").alias("pages"), F.count_if(has).alias("read"), F.bool_or(has).alias("any_read"), F.bool_and(has).alias("all_read"))


def storage_estimate(pages: DataFrame, quota: int) -> DataFrame:
    """``(usage, quota, percent)`` of the blobs' bytes, 100 at most."""
    used = F.coalesce(F.sum(sum((F.coalesce(F.length(c), F.lit(0)) for c in ("blob", "ocrBlob", "thumb")), F.lit(0))), F.lit(0)).cast("long")
    return pages.agg(used.alias("usage")).select("usage", F.lit(quota).cast("long").alias("quota"), F.least(F.lit(100.0), F.col("usage") / F.lit(float(quota)) * 100).alias("percent"))


def schema_problems(found: dict[str, T.StructType], keys: dict[str, str] | None = None) -> list[tuple[str, str]]:
    """(store, problem) of what is missing or differs; other stores are no problem."""
    out = []
    for name, (wanted, key) in schemas.STORES.items():
        if name not in found:
            out.append((name, "missing"))
            continue
        if keys is not None and keys.get(name, key) != key:
            out.append((name, f"wrong key {keys[name]}"))
        own = {f.name: f.dataType for f in found[name].fields}
        for f in wanted.fields:
            if f.name not in own:
                out.append((name, f"missing column {f.name}"))
            elif own[f.name].simpleString() != f.dataType.simpleString():
                out.append((name, f"column {f.name} is {own[f.name].simpleString()}"))
    return out


def catalog_name(path: str, spark: SparkSession) -> str:
    """A namespace of its own for each install path."""
    return spark.range(1).select(F.concat_ws("-", F.lit("leafmill"), F.nullif(slug(F.lit(path)), F.lit("")))).first()[0]


class Store:
    """The three tables under one folder."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _fs(self, path: str):
        where = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return where.getFileSystem(self.spark._jsc.hadoopConfiguration()), where

    def _pointer(self, name: str) -> str | None:
        fs, where = self._fs(f"{self.path}/{name}/CURRENT")
        return self.spark.read.text(where.toString()).first().value if fs.exists(where) else None

    def read(self, name: str) -> DataFrame:
        """The current version; empty if there is none yet."""
        version = self._pointer(name)
        schema = schemas.STORES[name][0]
        return self.spark.createDataFrame([], schema) if version is None else self.spark.read.schema(schema).parquet(f"{self.path}/{name}/{version}")

    def write(self, name: str, rows: DataFrame) -> None:
        """``rows`` as the new version; pages are laid out by document."""
        version, schema = f"v-{uuid.uuid4().hex}", schemas.STORES[name][0]
        shaped = rows.select(*(F.col(f.name).cast(f.dataType).alias(f.name) for f in schema.fields))
        if name == "pages":
            shaped = shaped.repartition("docId").sortWithinPartitions("docId", "index")
        shaped.write.parquet(f"{self.path}/{name}/{version}")
        # written beside it and moved over it, so that a reader finds the old version or the new one
        fs, beside = self._fs(f"{self.path}/{name}/{version}.current")
        out = fs.create(beside, True)
        out.write(bytearray(version.encode()))
        out.close()
        sc = self.spark.sparkContext
        rename = sc._jvm.org.apache.hadoop.fs.Options.Rename
        over = sc._gateway.new_array(rename, 1)
        over[0] = rename.OVERWRITE
        _, where = self._fs(f"{self.path}/{name}/CURRENT")
        sc._jvm.org.apache.hadoop.fs.FileContext.getFileContext(beside.toUri(), sc._jsc.hadoopConfiguration()).rename(beside, where, over)

    def problems(self) -> list[tuple[str, str]]:
        """Problems of the stored files, by their own schemas."""
        found = {}
        for name in schemas.STORES:
            version = self._pointer(name)
            if version is not None:
                found[name] = self.spark.read.parquet(f"{self.path}/{name}/{version}").schema
        return schema_problems(found)

    def repair(self) -> None:
        """Missing or wrong stores begin anew, the others stay."""
        for name in dict.fromkeys(n for n, _ in self.problems()):
            self.write(name, self.spark.createDataFrame([], schemas.STORES[name][0]))
