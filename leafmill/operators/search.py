"""Ranked full-text search with snippets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafmill.functions.text import normalise_query, snippet

TITLE_POINTS, PAGE_POINTS = 10, 5


def search(documents: DataFrame, pages: DataFrame, query: str) -> DataFrame:
    """``documents(id, title, updatedAt)`` and ``pages(docId, index, text)`` -> ``(id, title, updatedAt, score, snippet, matchPage)``.

    10 points if the title has the query, 5 for each page that has it, in either
    case; the snippet is the first matching page's. Ranked by score, then the
    latest, then id. An empty query has no hits. Pages are filtered and narrowed
    before their one shuffle, and only hits meet the documents.
    """
    spark = documents.sparkSession
    q = spark.range(1).select(normalise_query(F.lit(query)).alias("q")).first().q
    if not q:
        return documents.select("id", "title", "updatedAt", F.lit(0).cast("long").alias("score"), F.lit("").alias("snippet"), F.lit(None).cast("int").alias("matchPage")).where(F.lit(False))
    needle = F.lit(q)
    hits = pages.where(F.contains(F.lower("text"), needle)).select("docId", "index", snippet(F.col("text"), needle).alias("snippet"))
    per = hits.groupBy("docId").agg((PAGE_POINTS * F.count("*")).alias("points"), F.min_by("snippet", "index").alias("snippet"), F.min("index").alias("matchPage"))
    title = F.when(F.contains(F.lower(F.coalesce("title", F.lit(""))), needle), TITLE_POINTS).otherwise(0)
    joined = documents.select("id", "title", "updatedAt").join(per, F.col("id") == F.col("docId"), "left")
    scored = joined.select("id", "title", "updatedAt", (title + F.coalesce("points", F.lit(0))).cast("long").alias("score"), F.coalesce("snippet", F.lit("")).alias("snippet"), "matchPage")
    return scored.where("score > 0").orderBy(F.desc("score"), F.desc("updatedAt"), "id")
