"""Sharding by best-fit-decreasing bin packing of whole groups.

Rows of equal text are one group and never part. Groups enter in the order of
falling size, each the shard with the least room that still holds it, found in
a balanced tree of (room, shard).

A plan needs only how many groups have which size, so that is what reaches the
driver: sizes in classes of ten significant bits, at most ``1 << 10`` classes
for each power of two, whatever the number of rows. Groups of one class are
dealt by their rank in it. Sizes under ``EXACT`` are classes of their own and
are planned after the larger groups are placed and the real loads are known, so
that small groups level out what the classes rounded.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from leafmill.llm._shared import materialize, text_of

EXACT = 1 << 11
_BITS = 10
#: Parts in which ranks are counted, so that no class or shard is numbered in one task.
PARTS = 256
#: Parts of what a task writes, within which rows are numbered: one group may fill a task.
LANES = 16


class RoomTree:
    """A weight-balanced search tree of (room, shard) pairs as nested tuples (left, pair, right, size)."""

    def __init__(self):
        self.root = None

    @staticmethod
    def _node(left, pair, right):
        return left, pair, right, 1 + (left[3] if left else 0) + (right[3] if right else 0)

    def _balanced(self, left, pair, right):
        n, m = left[3] if left else 0, right[3] if right else 0
        if n + m > 1 and n > 3 * m:
            a, p, b, _ = left
            if (b[3] if b else 0) < 2 * (a[3] if a else 0):
                return self._node(a, p, self._node(b, pair, right))
            c, q, d, _ = b
            return self._node(self._node(a, p, c), q, self._node(d, pair, right))
        if n + m > 1 and m > 3 * n:
            a, p, b, _ = right
            if (a[3] if a else 0) < 2 * (b[3] if b else 0):
                return self._node(self._node(left, pair, a), p, b)
            c, q, d, _ = a
            return self._node(self._node(left, pair, c), q, self._node(d, p, b))
        return self._node(left, pair, right)

    def add(self, pair: tuple[int, int]) -> None:
        def put(t):
            if t is None:
                return self._node(None, pair, None)
            if pair < t[1]:
                return self._balanced(put(t[0]), t[1], t[2])
            return self._balanced(t[0], t[1], put(t[2]))

        self.root = put(self.root)

    def remove(self, pair: tuple[int, int]) -> None:
        def least(t):
            return least(t[0]) if t[0] else t[1]

        def cut(t, pair):
            if pair < t[1]:
                return self._balanced(cut(t[0], pair), t[1], t[2])
            if pair > t[1]:
                return self._balanced(t[0], t[1], cut(t[2], pair))
            if not t[0] or not t[2]:
                return t[0] or t[2]
            after = least(t[2])
            return self._balanced(t[0], after, cut(t[2], after))

        self.root = cut(self.root, pair)

    def at_least(self, room: int) -> tuple[int, int] | None:
        t, found = self.root, None
        while t:
            if t[1] >= (room, -1):
                found, t = t[1], t[0]
            else:
                t = t[2]
        return found

    def largest(self) -> tuple[int, int] | None:
        t = self.root
        while t and t[2]:
            t = t[2]
        return t[1] if t else None


def best_fit_decreasing(classes: list[tuple[int, int]], room: list[int], grow: int | None = None) -> dict[int, list[tuple[int, int]]]:
    """Runs of (number, shard) for each size. classes: (size, number); room: what each shard has left, changed in place.

    As many of a class as fit go into the tightest shard at once: it stays the
    tightest while they do. What fits nowhere opens a shard of ``grow`` room, or
    where that is None goes to the shard with the most room.
    """
    tree, runs = RoomTree(), {}
    for shard, r in enumerate(room):
        tree.add((r, shard))
    for size, number in sorted(classes, reverse=True):
        out = runs.setdefault(size, [])
        while number:
            pair = tree.at_least(size)
            if pair is None and grow is not None:
                pair = (max(grow, size), len(room))
                room.append(pair[0])
                tree.add(pair)
            if pair is None:
                pair, take = tree.largest(), 1
            else:
                take = min(number, pair[0] // size) if size else number
            tree.remove(pair)
            room[pair[1]] -= take * size
            tree.add((room[pair[1]], pair[1]))
            if out and out[-1][1] == pair[1]:
                out[-1] = (out[-1][0] + take, pair[1])
            else:
                out.append((take, pair[1]))
            number -= take
    return runs


def capacity(total: int, shards: int, large: list[tuple[int, int]]) -> int:
    """The fair share of each shard once groups above it have shards of their own. large: (size, number), any order."""
    share, left, n = -(-total // shards), total, shards
    for size, number in sorted(large, reverse=True):
        for _ in range(min(number, n)):
            if size <= share or n == 1:
                return share
            left, n = left - size, n - 1
            share = -(-left // n)
    return share


def _class_of(size: Column) -> Column:
    """Ten significant bits, exact under ``EXACT``."""
    shift = F.greatest(F.lit(0), F.length(F.bin(size)) - 1 - _BITS)
    return F.call_function("shiftleft", F.call_function("shiftright", size, shift), shift)


def _ranked(groups: DataFrame) -> DataFrame:
    """``rank`` from 0 of each group in its class: counted in parts, then within each part."""
    part = F.pmod(F.xxhash64("digest"), F.lit(PARTS))
    split = groups.withColumn("part", part)
    each = Window.partitionBy("class", "part").orderBy("digest")
    before = Window.partitionBy("class").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    counts = split.groupBy("class", "part").count().select("class", "part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("base"))
    return split.withColumn("own", F.row_number().over(each)).join(counts, ["class", "part"]).select("digest", "size", "class", (F.col("base") + F.col("own") - 1).alias("rank"))


def _dealt(spark: SparkSession, groups: DataFrame, runs: dict[int, list[tuple[int, int]]]) -> DataFrame:
    """Groups with the shard of their rank. The plan has a row for each class, a bounded number."""
    rows = []
    for size, found in runs.items():
        ends, n = [], 0
        for number, _ in found:
            n += number
            ends.append(n)
        rows.append((size, ends, [s for _, s in found]))
    plan = spark.createDataFrame(rows, "class long, ends array<long>, shards array<int>")
    place = F.size(F.filter("ends", lambda e: e <= F.col("rank"))) + 1
    return groups.join(F.broadcast(plan), "class").select("digest", "size", F.element_at("shards", place).alias("shard"))


def shard_groups(groups: DataFrame, shards: int) -> DataFrame:
    """``(digest, size)`` with sizes of at least 1 -> ``(digest, shard)``: sizes of shards as near equal as whole groups permit.

    A group above the fair share gets a shard of its own and the others share
    the rest. No groups give no rows.
    """
    spark = groups.sparkSession
    ranked = materialize(_ranked(groups.withColumn("class", _class_of(F.col("size")))), "ranked")
    classes = ranked.groupBy("class").agg(F.count("*").alias("n"), F.sum("size").alias("bytes"), F.max("size").alias("top")).collect()
    if not classes:
        return ranked.select("digest", F.lit(None).cast("int").alias("shard"))
    share = capacity(sum(c.bytes for c in classes), shards, [(c.bytes // c.n, c.n) for c in classes])
    large = [c for c in classes if c["class"] >= EXACT]
    # a class stands by its mean, which no other class shares as their sizes don't overlap
    runs = best_fit_decreasing([(c.bytes // c.n, c.n) for c in large], [share] * shards)
    first = materialize(_dealt(spark, ranked.where(F.col("class") >= EXACT), {c["class"]: runs[c.bytes // c.n] for c in large}), "large")
    room = [share] * shards
    for s in first.groupBy("shard").agg(F.sum("size").alias("bytes")).collect():
        room[s.shard] -= s.bytes
    runs = best_fit_decreasing([(c["class"], c.n) for c in classes if c["class"] < EXACT], room)
    second = _dealt(spark, ranked.where(F.col("class") < EXACT), runs)
    return first.select("digest", "shard").unionByName(second.select("digest", "shard"))


def fewest_shards(groups: list[tuple[str, int]], size: int) -> dict[str, int]:
    """The driver-side form for a short list: shard of each group, with as few shards of ``size`` as best fit decreasing needs."""
    room: list[int] = []
    classes: dict[int, list[str]] = {}
    for name, n in sorted(groups):
        classes.setdefault(n, []).append(name)
    runs = best_fit_decreasing([(n, len(names)) for n, names in classes.items()], room, size)
    out = {}
    for n, found in runs.items():
        names = iter(classes[n])
        out |= {next(names): shard for number, shard in found for _ in range(number)}
    return out


def _slots(rows: DataFrame) -> DataFrame:
    """Gapless ``slot`` from 0 in each shard: counted by ``lane``, a part of what one task wrote, then within each lane."""
    each = Window.partitionBy("shard", "lane").orderBy("doc_id", "digest")
    before = Window.partitionBy("shard").orderBy("lane").rowsBetween(Window.unboundedPreceding, -1)
    counts = rows.groupBy("shard", "lane").count().select("shard", "lane", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("base"))
    return rows.withColumn("own", F.row_number().over(each)).join(counts, ["shard", "lane"]).withColumn("slot", F.col("base") + F.col("own") - 1)


def shard_documents(docs: DataFrame, shards: int = 40) -> DataFrame:
    """``(doc_id, size, text_crc32, law, shard, slot, grown_shard)`` under the law ``bytes``.

    Size is the text's UTF-8 bytes (null: none) plus 16; a null text groups with
    the empty ones. Null and repeated doc_ids are rows like any other; no rows
    give no rows. The text is read once and never shuffled.
    """
    text = text_of()
    base = docs.select("doc_id", F.sha2(text, 256).alias("digest"), (F.octet_length(text).cast("long") + 16).alias("size"), F.crc32(F.encode(text, "UTF-8")).cast("long").alias("text_crc32"))
    base = materialize(base, "sized")
    groups = base.groupBy("digest").agg(F.sum("size").alias("size"))
    placed = shard_groups(groups, shards)
    rows = materialize(base.join(placed, "digest").withColumn("lane", F.spark_partition_id() * LANES + F.pmod(F.xxhash64("doc_id"), F.lit(LANES))), "placed")
    return _slots(rows).select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
