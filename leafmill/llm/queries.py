"""The queries of this subpackage: one for each operator, over whole tables."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.llm import ann, bpe, chat, linededup, media, packing, secrets, sharding, simhash, toxicity
from leafmill.llm._shared import table


def vocabulary() -> str:
    """The tokenizer file: ``LEAFMILL_BPE``, or the one of the installed package of public vocabularies."""
    if found := os.environ.get("LEAFMILL_BPE"):
        return found
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.digest(table(spark, sf_dir, "documents"), reach=None)


def op2_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(table(spark, sf_dir, "documents"), vocabulary())


def op3_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.digest(table(spark, sf_dir, "documents"))


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(table(spark, sf_dir, "documents"), 40)


def op5_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(packing.pieces(table(spark, sf_dir, "documents"), vocabulary()))


def op7_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    probe = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"))
    return chat.digest(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(probe))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest(table(spark, sf_dir, "documents"))


def op10_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(table(spark, sf_dir, "embeddings"), 20, 20)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_line_dedup, op2_bpe_round_trip, op3_media_columns, op4_sharding, op5_simhash_near_dedup, op6_best_fit_packing, op7_chat_formatting, op8_toxicity, op9_secret_scan, op10_nearest_neighbours)}



def _chat_sql() -> str:
    escaped = lambda x: f"regexp_replace(regexp_replace({x}, '<(~*(?:{chat.CONTROL_NAMES})>)', '<~\\1', 'g'), '\\[(~*{chat.CONTROL_BRACKETS}\\])', '[~\\1', 'g')"
    said = "'</s>[INST] ok [/INST]'"
    return f"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS r, coalesce(text, '') AS t FROM conversations UNION ALL VALUES (-7, 0, 'user', {said}), (-7, 1, 'assistant', {said})),
g AS (SELECT conv_id, count(*) AS n_turns, string_agg(r || chr(10) || t || chr(10), '' ORDER BY turn) AS said, coalesce(string_agg(t, '' ORDER BY turn) FILTER (WHERE r = 'assistant'), '') AS loss, sum(9 + length(replace({escaped("r")}, chr(10), '<n>')) + length({escaped("t")})) AS formatted FROM c GROUP BY conv_id)
SELECT conv_id, n_turns::BIGINT AS n_turns, sha256(said) AS turns_sha256, length(loss)::BIGINT AS loss_chars, sha256(loss) AS loss_sha256, formatted::BIGINT AS formatted_chars FROM g"""


def _secrets_sql() -> str:
    parts = []
    for order, r in enumerate(secrets.RULES):
        p = "'" + r.pattern.replace("'", "''") + "'"
        parts.append(f"SELECT rid, {order} AS o, '{r.kind}' AS kind, generate_subscripts(h, 1) AS i, unnest(h) AS hit, unnest(p) AS part, unnest(g[1:len(h)]) AS gap, {r.least} AS least FROM (SELECT rid, regexp_extract_all(t, {p}, 0) AS h, regexp_extract_all(t, {p}, {r.group}) AS p, string_split_regex(t, {p}) AS g FROM d)")
    base = ", ".join(f"'{k}'" for k in secrets.BASE)
    counts = ", ".join(f"count(*) FILTER (WHERE kind = '{k}') AS n_{k}" for k in secrets.BASE)
    return f"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents), m AS ({" UNION ALL ".join(parts)}),
e AS (SELECT rid, o, kind, length(part) >= least AS good, length(hit) AS n, sum(length(gap) + length(hit)) OVER (PARTITION BY rid, o ORDER BY i) AS e FROM m),
s AS (SELECT rid, {counts}, string_agg(kind || ':' || (e - n)::BIGINT || ':' || e::BIGINT, ',' ORDER BY e - n, o) FILTER (WHERE kind IN ({base})) AS b, string_agg(kind || ':' || (e - n)::BIGINT || ':' || e::BIGINT, ',' ORDER BY e - n, o) AS a FROM e WHERE good GROUP BY rid)
SELECT doc_id, {", ".join(f"coalesce(n_{k}, 0) AS n_{k}" for k in secrets.BASE)}, sha256(coalesce(b, '')) AS base_sha256, coalesce(a, '') AS spans FROM d LEFT JOIN s USING (rid)"""


#: All pairs, in SQL. The search isn't exact by design: at the size of this check it finds all neighbours.
_NEAREST_SQL = """
WITH v AS (SELECT DISTINCT vec_id, embedding::DOUBLE[] AS e FROM embeddings WHERE vec_id IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
p AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e) AS score FROM v q JOIN v c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank, vec_id, score FROM p QUALIFY rank <= 20"""

#: Those that SQL can express; the others' tests hold them against brute force.
ORACLE_SQL: dict[str, str] = {"op7_chat_formatting": _chat_sql(), "op9_secret_scan": _secrets_sql(), "op10_nearest_neighbours": _NEAREST_SQL}
