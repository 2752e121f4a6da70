"""Secret scans through a trigram inverted index, with built-in functions only.

Each rule's pattern is read once, on the driver, for the trigrams that any match
must have: a conjunction of parts, each a choice of strings of which one must
occur. The index lists, for the trigrams that rules ask for, the texts that have
them. Intersecting its postings gives each rule's candidates, which alone are
verified by the pattern; a rule without mandatory trigrams scans all texts.

Texts are known by two 64-bit hashes, so copies are indexed and verified once.
Places are counted in code points, from the gaps between matches and the matches.
"""

from __future__ import annotations

import re._constants as sre
import re._parser as sre_parse
from itertools import product
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafmill.llm._shared import apart, marked, materialize, text_of, together


class Rule(NamedTuple):
    kind: str
    pattern: str
    #: A match counts if this group has ``least`` characters or more.
    group: int = 0
    least: int = 1


# The base rules, then those that this operator adds.
RULES = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    # a run is matched whole or not at all, so the least length can stand in the pattern: 16 characters, and 32
    Rule("access", r"AKIA[A-Z0-9]{12,}"),
    Rule("hex", r"[0-9a-f]{32,}"),
    Rule("pem", r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}"),
    Rule("google", r"AIza[0-9A-Za-z_-]{35}"),
)
BASE = ("assign", "access", "hex")

#: Choices of strings are followed up to this number.
MOST_CHOICES = 64


class _Choices:
    """What has been read of a pattern: parts that are complete, and the strings that the open end may have."""

    def __init__(self):
        self.parts: list[frozenset[frozenset[str]]] = []
        self.open: set[str] = {""}

    def close(self) -> None:
        found = frozenset(frozenset(x[i : i + 3] for i in range(len(x) - 2)) for x in self.open)
        found = frozenset(x for x in found if not any(y < x for y in found))
        if all(found):
            self.parts.append(found)
        self.open = {""}

    def then(self, strings: set[str] | None) -> None:
        if strings is None:
            self.close()
            return
        after = {a + b for a, b in product(self.open, strings)}
        if len(after) > MOST_CHOICES:
            self.close()
            after = strings
        self.open = after


def _strings(op, arg) -> set[str] | None:
    """All strings of one element if they are few, in lower case."""
    if op is sre.LITERAL:
        return {chr(arg).lower()}
    if op is sre.IN:
        out: set[str] = set()
        for kind, value in arg:
            if kind is sre.LITERAL:
                out.add(chr(value).lower())
            elif kind is sre.RANGE and value[1] - value[0] < 8:
                out |= {chr(c).lower() for c in range(value[0], value[1] + 1)}
            else:
                return None
        return out if len(out) <= 8 else None
    if op is sre.BRANCH:
        out = set()
        for way in arg[1]:
            found = _sequence(way)
            if found is None:
                return None
            out |= found
        return out
    if op is sre.SUBPATTERN:
        return _sequence(arg[3])
    if op in (sre.MAX_REPEAT, sre.MIN_REPEAT):
        low, high, inner = arg
        found = _sequence(inner)
        if found is None or high is sre.MAXREPEAT or high > 3:
            return None
        out = set()
        for n in range(low, high + 1):
            out |= {"".join(x) for x in product(found, repeat=n)}
        return out if len(out) <= MOST_CHOICES else None
    return None


def _sequence(items) -> set[str] | None:
    out = {""}
    for op, arg in items:
        found = _strings(op, arg)
        if found is None or len(out) * len(found) > MOST_CHOICES:
            return None
        out = {a + b for a, b in product(out, found)}
    return out


def _read(items, to: _Choices) -> None:
    for op, arg in items:
        found = _strings(op, arg)
        if found is None and op is sre.SUBPATTERN:
            _read(arg[3], to)
        elif found is None and op in (sre.MAX_REPEAT, sre.MIN_REPEAT) and arg[0] >= 1:
            _read(arg[2], to)
            to.close()
        else:
            to.then(found)


def trigram_query(pattern: str) -> list[frozenset[frozenset[str]]]:
    """Parts that all must hold; a part holds if all trigrams of one of its choices occur in the lower-cased text. Empty: no part is mandatory."""
    to = _Choices()
    _read(sre_parse.parse(pattern), to)
    to.close()
    return list(dict.fromkeys(to.parts))


def _keys(text: Column) -> list[Column]:
    return [F.xxhash64(text).alias("k1"), F.xxhash64(F.lit(1), text).alias("k2")]


def build_index(texts: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``(text)`` -> postings ``(trigram, k1, k2)`` for the trigrams that the rules ask for."""
    wanted = sorted({t for r in rules for part in trigram_query(r.pattern) for choice in part for t in choice})
    low = texts.select(F.lower("text").alias("low"), *_keys(F.col("text")))
    if not wanted:
        return low.where(F.lit(False)).select(F.lit("").alias("trigram"), "k1", "k2")
    has = F.array_compact(F.array(*(F.when(F.contains("low", F.lit(t)), F.lit(t)) for t in wanted)))
    return low.select(F.explode(has).alias("trigram"), "k1", "k2").distinct()


def candidates(postings: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``(k1, k2, kinds)``: the texts whose postings satisfy the query of each of ``kinds``."""
    rows, parts = [], {}
    for r in rules:
        query = trigram_query(r.pattern)
        parts[r.kind] = len(query)
        rows += [(r.kind, p, c, t, len(choice)) for p, part in enumerate(query) for c, choice in enumerate(sorted(part, key=sorted)) for t in sorted(choice)]
    spark = postings.sparkSession
    # as many rows as the rules have trigrams
    asked = spark.createDataFrame(rows or [("", 0, 0, "", 1)], "kind string, part int, choice int, trigram string, need long")
    total = F.create_map(*(F.lit(x) for kind, n in parts.items() for x in (kind, n)))
    met = postings.join(F.broadcast(asked), "trigram").groupBy("k1", "k2", "kind", "part", "choice").agg(F.count("*").alias("n"), F.first("need").alias("need")).where("n = need")
    whole = met.groupBy("k1", "k2", "kind").agg(F.count_distinct("part").alias("parts")).where(F.col("parts") == total[F.col("kind")])
    return whole.groupBy("k1", "k2").agg(F.sort_array(F.collect_set("kind")).alias("kinds"))


def _matches(texts: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """``(k1, k2, text, kinds)`` -> ``(k1, k2, kind, n, gap, size, counts)``: every match of the rules in ``kinds``, n from 0."""
    out = []
    for r in rules:
        some = texts.where(F.array_contains("kinds", r.kind) & F.col("text").rlike(r.pattern))
        row = F.arrays_zip(F.split("text", r.pattern).alias("gap"), F.regexp_extract_all("text", F.lit(r.pattern), F.lit(0)).alias("hit"), F.regexp_extract_all("text", F.lit(r.pattern), F.lit(r.group)).alias("part"))
        rows = some.select("k1", "k2", F.posexplode(row).alias("n", "m")).where("m.hit is not null")
        out.append(rows.select("k1", "k2", F.lit(r.kind).alias("kind"), "n", F.length("m.gap").cast("long").alias("gap"), F.length("m.hit").cast("long").alias("size"), (F.length("m.part") >= r.least).alias("counts")))
    found = out[0]
    for x in out[1:]:
        found = found.unionByName(x)
    return found


def spans(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``(k1, k2, spans array<struct<start, rule, kind, end>>)`` for every text that has any, by start and then the rules' order."""
    texts = docs.select(text_of().alias("text")).select("text", *_keys(F.col("text")))
    mandatory = tuple(r for r in rules if trigram_query(r.pattern))
    full = tuple(r for r in rules if not trigram_query(r.pattern))
    parts = []
    if mandatory:
        postings = materialize(build_index(texts, mandatory), "postings")
        found = materialize(candidates(postings, mandatory), "candidates")
        once = marked(texts, "k1", found.select("k1")).where("_marked").groupBy("k1", "k2").agg(F.first("text").alias("text"))
        parts.append(_matches(once.join(found, ["k1", "k2"]), mandatory))
    if full:
        parts.append(_matches(texts.withColumn("kinds", F.array(*(F.lit(r.kind) for r in full))), full))
    found = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    # copies of a text that was scanned fully give their matches again
    found = found.groupBy("k1", "k2", "kind", "n").agg(F.first("gap").alias("gap"), F.first("size").alias("size"), F.first("counts").alias("counts"))
    upto = Window.partitionBy("k1", "k2", "kind").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum(F.col("gap") + F.col("size")).over(upto)
    order = F.create_map(*(F.lit(x) for i, r in enumerate(rules) for x in (r.kind, i)))
    placed = found.withColumn("end", end).where("counts").withColumn("start", F.col("end") - F.col("size")).withColumn("rule", order[F.col("kind")])
    return placed.groupBy("k1", "k2").agg(F.sort_array(F.collect_list(F.struct("start", "rule", "kind", "end"))).alias("spans"))


def _joined(found: Column) -> Column:
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def digest(docs: DataFrame) -> DataFrame:
    """``(doc_id, n_assign, n_access, n_hex, base_sha256, spans)``, one row for each row.

    Null texts count as empty: no spans, and the hash of the empty string. Null
    and repeated doc_ids stay; no rows give no rows.
    """
    found = materialize(spans(docs), "spans")
    own = docs.select("doc_id", *_keys(text_of()))
    rows = own.join(found, ["k1", "k2"], "left").select("doc_id", F.coalesce("spans", F.array().cast("array<struct<start:bigint,rule:int,kind:string,end:bigint>>")).alias("spans"))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("spans", lambda s: s["kind"].isin(*BASE))
    return rows.select("doc_id", *(count(k) for k in BASE), F.sha2(_joined(base), 256).alias("base_sha256"), _joined(F.col("spans")).alias("spans"))


def redact(docs: DataFrame, mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with each run of overlapping spans replaced by ``mark``. All rows and columns stay; a null text stays null."""
    found = materialize(spans(docs), "spans").withColumnsRenamed({"k1": "_k1", "k2": "_k2", "spans": "_spans"})
    # runs of overlapping spans, as (start, end), in order
    merged = F.aggregate(
        "_spans",
        F.array().cast("array<struct<start:bigint,end:bigint>>"),
        lambda done, s: F.when(
            (F.size(done) > 0) & (s["start"] < F.coalesce(F.get(done, F.size(done) - 1)["end"], F.lit(-1))),
            F.concat(F.slice(done, F.lit(1), F.size(done) - 1), F.array(F.struct(F.get(done, F.size(done) - 1)["start"].alias("start"), F.greatest(F.get(done, F.size(done) - 1)["end"], s["end"]).alias("end")))),
        ).otherwise(F.concat(done, F.array(F.struct(s["start"].alias("start"), s["end"].alias("end"))))),
    )
    runs = materialize(found.select("_k1", "_k2", merged.alias("_runs")), "runs")
    edges = F.concat(F.array(F.lit(0).cast("long")), F.transform("_runs", lambda r: r["end"]))
    kept = F.transform(edges, lambda e, i: F.substring(F.col("text"), (e + 1).cast("int"), (F.coalesce(F.get("_runs", i)["start"], F.length("text").cast("long")) - e).cast("int")))
    own = apart(docs).withColumns({"_a": F.xxhash64(text_of()), "_b": F.xxhash64(F.lit(1), text_of())})
    own = marked(own, "_a", runs.select("_k1"))
    joined = own.where("_marked").join(runs, (F.col("_a") == F.col("_k1")) & (F.col("_b") == F.col("_k2")), "left")
    clean = F.when(F.col("_runs").isNull() | F.col("text").isNull(), F.col("text")).otherwise(F.array_join(kept, mark))
    return together(own.where("not _marked").select("text", "rest").unionByName(joined.select(clean.alias("text"), "rest")), docs.columns)
