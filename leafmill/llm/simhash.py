"""SimHash fingerprints and their near-duplicate groups by multi-index hashing.

A fingerprint of 64 bits has two segments of 32. Two fingerprints that differ in
at most three bits differ in at most one within one of the segments. So each
fingerprint is filed under both its segment values, and looks up, in the table
of each segment, the ball of values within one bit of its own; what it meets
there is verified over all 64 bits. A pair that differs by one bit within a
segment is looked up from the side where that bit is 0, which halves the ball.

Equal fingerprints are one node. What meets under a segment value is read from
sorted partitions as a stream, and of the links found there only as many as
connect them are passed on: no group is ever listed pair by pair.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafmill.llm._shared import apart, marked, materialize, text_of, together
from leafmill.llm.components import connected_components

SEED = 42
SHINGLE = 3
DISTANCE = 3
SEGMENT_BITS = 32
#: Runs up to this length are compared by shifts over all runs at once, up to the next one row by row.
SHORT_RUN, LONG_RUN = 24, 4096


def fingerprint(text: str, shingle: int = SHINGLE) -> int:
    """64 bits, unsigned: a bit is 1 where more than half of the shingle hashes have it."""
    words = text.encode().lower().split()
    if not words:
        return 0
    if len(words) < shingle:
        grams = [b" ".join(words)]
    else:
        grams = list(map(b" ".join, zip(*(words[i:] for i in range(shingle)))))
    hashed = np.array([xxhash.xxh64_intdigest(g, SEED) for g in grams], np.uint64)
    total = np.zeros(64, np.int64)
    for k in range(0, len(hashed), 1 << 16):
        total += np.unpackbits(hashed[k : k + (1 << 16)].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * total > len(hashed)).tobytes(), "big")


def fingerprints(docs: DataFrame, text: str = "text", shingle: int = SHINGLE, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns and ``fingerprint long`` (the 64 bits as a signed number). Null texts have no words: fingerprint 0."""
    kept = docs.select(*(docs[k] for k in keep), text_of(text).alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            t = x.column(x.schema.get_field_index("_text"))
            fps = np.array([fingerprint(s, shingle) for s in t.to_pylist()], np.uint64).view(np.int64)
            columns = [x.column(i) for i, f in enumerate(x.schema) if f.name != "_text"]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(fps)], [*(f.name for f in x.schema if f.name != "_text"), "fingerprint"])

    out = ", ".join(f"`{k}` {kept.schema[k].dataType.simpleString()}" for k in keep)
    return kept.mapInArrow(run, f"{out}, fingerprint long")


class Links:
    """Union-find over what was linked so far; ``add`` tells whether a link joins two parts."""

    def __init__(self):
        self.up: dict[int, int] = {}

    def root(self, x: int) -> int:
        up = self.up
        while (y := up.get(x, x)) != x:
            up[x] = x = up.get(y, y)
        return x

    def add(self, x: int, y: int) -> bool:
        x, y = self.root(x), self.root(y)
        if x == y:
            return False
        self.up[max(x, y)] = min(x, y)
        return True


def sorted_runs(batches: Iterator[pa.RecordBatch], names: tuple[str, ...]) -> Iterator[tuple[np.ndarray, ...]]:
    """Columns of batches sorted by the first one, re-cut so that no run of a key is divided."""
    kept: list[tuple[np.ndarray, ...]] = []
    for x in batches:
        now = tuple(x.column(x.schema.get_field_index(n)).to_numpy(zero_copy_only=False) for n in names)
        key = now[0]
        if not len(key):
            continue
        cut = int(np.searchsorted(key, key[-1]))
        if cut:
            yield tuple(np.concatenate(c) for c in zip(*kept, tuple(c[:cut] for c in now)))
            kept = []
        kept.append(tuple(c[cut:] for c in now))
    if kept:
        yield tuple(np.concatenate(c) for c in zip(*kept))


def runs_of(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start, length) of the runs of equal keys."""
    start = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    return start, np.diff(np.append(start, len(key)))


def near(a: np.ndarray, b: np.ndarray, distance: int) -> np.ndarray:
    return np.bitwise_count(a ^ b) <= distance


def short_pairs(start: np.ndarray, length: np.ndarray, check: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of verified pairs within short runs: all runs at once, by the distance of the two places."""
    for d in range(1, int(length.max(initial=1))):
        some = length > d
        n = length[some] - d
        i = np.repeat(start[some], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        hit = check(i, i + d)
        yield i[hit], i[hit] + d


def spanning(values: np.ndarray, filed: np.ndarray, distance: int, links: Links) -> Iterator[tuple[int, int]]:
    """Links that connect what lies within ``distance``, of a run in which one of two must be filed under the key."""
    part = np.arange(len(values))
    for i in np.flatnonzero(filed):
        hit = np.flatnonzero(near(values[i], values, distance) & (part != part[i]))
        for j in np.unique(part[hit], return_index=True)[1]:
            j = hit[j]
            if links.add(int(values[i]), int(values[j])):
                yield int(values[i]), int(values[j])
        if len(hit):
            part[np.isin(part, part[hit])] = part[i]


def link_run(values: np.ndarray, filed: np.ndarray, high: bool, distance: int, links: Links) -> Iterator[tuple[int, int]]:
    """As :func:`spanning`. A long run is divided by each byte of the half it was not filed by: near values share one of those four."""
    if len(values) <= LONG_RUN:
        yield from spanning(values, filed, distance, links)
        return
    for byte in range(4) if high else range(4, 8):
        b = values >> np.uint64(8 * byte) & np.uint64(255)
        order = np.argsort(b, kind="stable")
        for s, n in zip(*runs_of(b[order])):
            if n > 1:
                own = order[s : s + n]
                yield from spanning(values[own], filed[own], distance, links)


def link_sorted(batches: Iterator[pa.RecordBatch], distance: int = DISTANCE) -> Iterator[pa.RecordBatch]:
    """Rows (key, value, filed) sorted by key -> links (u, v) that connect all near pairs of each key with a filed one."""
    for key, value, filed in sorted_runs(batches, ("key", "value", "filed")):
        value, links, found = value.view(np.uint64), Links(), []
        start, length = runs_of(key)
        some = (length > 1) & np.logical_or.reduceat(filed, start)
        start, length = start[some], length[some]
        short = length <= SHORT_RUN

        def check(i: np.ndarray, j: np.ndarray) -> np.ndarray:
            return (filed[i] | filed[j]) & near(value[i], value[j], distance)

        for i, j in short_pairs(start[short], length[short], check):
            found += [(int(a), int(b)) for a, b in zip(value[i], value[j]) if a != b and links.add(int(a), int(b))]
        for s, n in zip(start[~short], length[~short]):
            found += link_run(value[s : s + n], filed[s : s + n], bool(key[s] >> SEGMENT_BITS), distance, links)
        ends = np.array(found, np.uint64).reshape(-1, 2)
        yield pa.RecordBatch.from_arrays([pa.array(ends[:, 0].view(np.int64)), pa.array(ends[:, 1].view(np.int64))], ["u", "v"])


def fingerprint_links(values: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """Distinct ``fingerprint long`` -> links ``(u, v)`` whose components are those of all pairs within ``distance`` (3 at most)."""
    if not 0 <= distance <= 3:
        raise ValueError("two segments with balls of one bit find up to three differing bits")
    low = (1 << SEGMENT_BITS) - 1
    halves = [F.col("fingerprint").bitwiseAND(F.lit(low)), F.shiftrightunsigned("fingerprint", SEGMENT_BITS)]

    def entries(which: int):
        half, mark, one = halves[which], F.lit(which << SEGMENT_BITS).cast("long"), F.lit(1).cast("long")
        zeros = F.filter(F.sequence(F.lit(0), F.lit(SEGMENT_BITS - 1)), lambda b: F.call_function("shiftright", half, b).bitwiseAND(one) == 0)
        ball = F.transform(zeros, lambda b: F.struct((half + mark + F.call_function("shiftleft", one, b)).alias("key"), F.lit(False).alias("filed")))
        return F.concat(F.array(F.struct((half + mark).alias("key"), F.lit(True).alias("filed"))), ball)

    probes = values.select("fingerprint", F.explode(F.concat(entries(0), entries(1))).alias("e")).select("e.key", F.col("fingerprint").alias("value"), "e.filed")
    spark = values.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = probes.repartition(parts, "key").sortWithinPartitions("key")
    return dealt.mapInArrow(lambda b: link_sorted(b, distance), "u long, v long")


def near_groups(fps: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """``(doc_id, fingerprint)`` -> ``(fingerprint, root, component_id)``.

    ``root`` is the group's least fingerprint, ``component_id`` its smallest
    doc_id, null where all of them are null.
    """
    nodes = materialize(fps.groupBy("fingerprint").agg(F.min("doc_id").alias("least")), "nodes")
    roots = connected_components(fingerprint_links(nodes.select("fingerprint"), distance))
    joined = nodes.join(roots, nodes.fingerprint == roots.node, "left").select("fingerprint", "least", F.coalesce("root", "fingerprint").alias("root"))
    joined = materialize(joined, "rooted")
    least = materialize(joined.groupBy("root").agg(F.min("least").alias("component_id")), "least")
    return joined.join(least, "root").select("fingerprint", "root", "component_id")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """``(doc_id, fingerprint hex, component_id)``, one row for each row.

    Null and empty texts have the fingerprint 0 and link like any other; null
    doc_ids are grouped but never name a group; repeated rows are linked to
    themselves; no rows give no rows.
    """
    fps = materialize(fingerprints(docs), "fingerprints")
    return fps.join(near_groups(fps), "fingerprint").select("doc_id", F.lpad(F.lower(F.hex("fingerprint")), 16, "0").alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame) -> DataFrame:
    """The documents of which no group has more than one: the one with the smallest doc_id stays.

    Where ids are null or repeated, the smallest text hash decides next; rows
    repeated in id and text leave one. Null ids come last. All columns stay, and
    the texts of what goes are never shuffled beyond one join.
    """
    own = apart(docs).withColumn("_hash", F.xxhash64(text_of()))
    fps = materialize(fingerprints(own, keep=("doc_id", "_hash")), "fingerprints")
    rank = F.struct(F.col("doc_id").isNull().alias("n"), F.col("doc_id").alias("i"), F.col("_hash").alias("h"))
    per = fps.groupBy("fingerprint").agg(F.min(rank).alias("least"))
    least = per.join(near_groups(fps), "fingerprint").groupBy("root").agg(F.min("least").alias("least")).select("least.i", "least.h")
    same = fps["doc_id"].eqNullSafe(F.col("i")) & (fps["_hash"] == F.col("h"))
    stay = materialize(fps.join(least, same).groupBy("i", "h").agg(F.count("*").alias("_rows")), "stay")
    some = marked(own, "_hash", stay.select("h")).where("_marked")
    joined = some.join(stay, some["doc_id"].eqNullSafe(stay["i"]) & (some["_hash"] == stay["h"]))
    once, more = joined.where("_rows = 1"), joined.where("_rows > 1").dropDuplicates(["i", "h"])
    return together(once.select("text", "rest").unionByName(more.select("text", "rest")), docs.columns)
