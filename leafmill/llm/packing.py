"""Sum-of-squares packing of token documents into sequences of fixed length.

Only counts matter to the rule: of the open sequences, how many have each
residual gap. A piece goes where the sum of the squares of these counts becomes
smallest, so gaps that many sequences share are the ones that get used up.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafmill.llm._shared import materialize, text_of
from leafmill.llm.bpe import _SPACE, tokenizer

SEQUENCE = 1024
END_ID = 2
#: Pieces that one packing task holds: some 40 bytes each, and far more than there are gaps.
PIECES_IN_TASK = 150_000
#: White space of this length and more is encoded apart: the fast encoder's pattern fails on a million of it.
LONG_SPACE = 100_000


@lru_cache(maxsize=4)
def _fast_encoder(path: str, whole: bool = False):
    """The vocabulary as a rank-based encoder, of texts or of ``whole`` pieces. It holds because each merge's rank is the order of its id."""
    bpe = tokenizer(path)
    special = set(bpe.special.values())
    ids = [x & 0xFFFFF for x in bpe.pair_of.values()]
    ranks = [x >> 20 for x in bpe.pair_of.values()]
    if [i for _, i in sorted(zip(ranks, ids))] != sorted(ids):
        raise ValueError("the merges of this vocabulary aren't in the order of their ids")
    # Fixed value: the pre-tokeniser pattern of the vocabulary files.
    pattern = r"(?s).+" if whole else r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
    return tiktoken.Encoding("json", pat_str=pattern, mergeable_ranks={b: i for i, b in enumerate(bpe.bytes_of) if i not in special}, special_tokens=bpe.special)


@lru_cache(maxsize=2)
def encoder(path: str) -> Callable[[str], np.ndarray]:
    """Text -> ids, for any text. A long run of white space is one piece but for its last character, which what follows may take."""
    fast, piece = _fast_encoder(path).encode_to_numpy, _fast_encoder(path, True).encode_to_numpy
    long_space = re.compile(rf"[{_SPACE}]{{{LONG_SPACE},}}")

    def encode(text: str) -> np.ndarray:
        if len(text) < LONG_SPACE:
            return fast(text, allowed_special="all")
        out, at = [], 0
        for m in long_space.finditer(text):
            end = m.end() - (m.end() < len(text))
            out += [fast(text[at : m.start()], allowed_special="all"), piece(text[m.start() : end])]
            at = end
        return np.concatenate([*out, fast(text[at:], allowed_special="all")])

    return encode


def pieces(docs: DataFrame, path: str, length: int = SEQUENCE, end_id: int = END_ID) -> DataFrame:
    """``(doc_id, piece, start, length, ids_crc32)``: documents with their end id, cut only if longer than ``length``.

    A long one is cut so that its first piece is the shorter one and all others
    are full. Null texts are documents of the end id alone.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = encoder(path)
        for x in batches:
            rows = []
            for i, text in zip(x["doc_id"], x["text"]):
                ids = np.append(encode(text), end_id).astype("<u4")
                first = len(ids) % length or min(length, len(ids))
                cuts = [0, *range(first, len(ids) + 1, length)]
                rows += [(i, k, a, b - a, zlib.crc32(ids[a:b])) for k, (a, b) in enumerate(zip(cuts, cuts[1:]))]
            out = pd.DataFrame(rows, columns=["doc_id", "piece", "start", "length", "ids_crc32"])
            yield out.astype({"doc_id": "Int64"})

    return docs.select("doc_id", text_of().alias("text")).mapInPandas(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


def sum_of_squares(lengths: np.ndarray, size: int = SEQUENCE) -> tuple[np.ndarray, np.ndarray, int]:
    """(bin, offset) of each length, all in 1 .. size - 1, in the given order, and the number of bins.

    With N(g) open bins of gap g, putting s into a gap g changes the sum of
    squares by 2 - 2 N(g) + 2 N(g - s), where the full gap 0 counts nothing:
    1 - 2 N(s) for the exact gap. Ties go to the tightest gap. A new bin is
    opened only if no open one has room, which saves sequences when the longest
    pieces come first.
    """
    count, never = np.zeros(size + 1, np.int64), np.int64(1) << 60
    open_bins: list[list[int]] = [[] for _ in range(size + 1)]
    where, offset, bins = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64), 0
    for k, s in enumerate(lengths.tolist()):
        change = 2 + 2 * (count[: size - s] - count[s:size])
        change[0] = 1 - 2 * count[s]
        change[count[s:size] == 0] = never
        j = int(change.argmin())
        if change[j] == never:
            gap, b, bins = size, bins, bins + 1
        else:
            gap = s + j
            b = open_bins[gap].pop()
            count[gap] -= 1
        where[k], offset[k] = b, size - gap
        if gap > s:
            open_bins[gap - s].append(b)
            count[gap - s] += 1
    return where, offset, bins


def pack(found: DataFrame, length: int = SEQUENCE) -> DataFrame:
    """Pieces with ``sequence_id`` and ``offset``.

    Full pieces are sequences of their own. The rest is dealt evenly over tasks
    of about ``PIECES_IN_TASK`` pieces, each packed alone, longest first: rows are dealt by
    their place in the written table, never by key, so no key can make a task
    large. Null doc_ids and repeated rows are pieces like any other; no pieces
    give no rows.
    """
    found = materialize(found, "pieces")
    tasks = -(-max(1, found.where(F.col("length") < length).count()) // PIECES_IN_TASK)
    numbered = found.withColumn("place", F.monotonically_increasing_id())
    full = numbered.where(F.col("length") >= length).select("doc_id", "piece", "start", "length", "ids_crc32", (-F.col("place") - 1).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))

    def run(key: tuple, x: pd.DataFrame) -> pd.DataFrame:
        x = x.sort_values(["length", "place"], ascending=[False, True])
        x["sequence_id"], x["offset"], n = sum_of_squares(x["length"].to_numpy(), length)
        x["sequence_id"] += int(key[0]) << 32
        return x[["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]].astype({"doc_id": "Int64"})

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    rest = numbered.where(F.col("length") < length).withColumn("task", F.pmod(F.xxhash64("place"), F.lit(tasks)))
    return full.unionByName(rest.groupBy("task").applyInPandas(run, schema))
