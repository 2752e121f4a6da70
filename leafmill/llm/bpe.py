"""Byte-level BPE encoding and decoding.

The merges of a piece run on a segment tree over its adjacent pairs: a leaf
holds the rank of the pair that starts at its symbol, an inner node the least of
its two halves, so the root is the leftmost pair of lowest rank. A merge changes
three leaves, each in logarithmic time, until the root says that no pair merges.
"""

from __future__ import annotations

import hashlib
import json
import re
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame

from leafmill.llm._shared import text_of

# The pre-tokeniser pattern of the vocabulary files, white space spelled out as Unicode's property.
_SPACE = r"\t-\r \x85\xa0  -     　"
_PIECES = rf"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{_SPACE}\p{{L}}\p{{N}}]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+"""

_pieces = regex.compile(_PIECES).findall
#: A blank before white space or the end: there the cheap split at blanks would not follow the pattern.
_odd_blank = re.compile(rf" (?:[{_SPACE}]|\Z)").search
_before_word = re.compile(rf"(?= [^{_SPACE}])").split

#: Entries a worker keeps, of chunks and of pieces each.
CACHE_ENTRIES = 700_000
_NEVER = 1 << 62


def byte_alphabet() -> list[str]:
    """The printable character standing for each byte in byte-level vocabularies."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b if b in shown else next(spare)) for b in range(256)]


def merge_pairs(symbols: list[int], pair_of: dict[int, int]) -> list[int]:
    """Merge until no pair is left. ``pair_of`` has ``rank << 20 | merged id`` by ``left << 32 | right``."""
    n = len(symbols)
    if n < 2:
        return symbols
    look = pair_of.get
    width = 1 << (n - 2).bit_length() if n > 2 else 1
    bits = n.bit_length()
    mask = (1 << bits) - 1
    rank = [look(symbols[i] << 32 | symbols[i + 1], _NEVER) for i in range(n - 1)]
    tree = [_NEVER] * width + [(r >> 20 << bits | i) if r != _NEVER else _NEVER for i, r in enumerate(rank)] + [_NEVER] * (width - n + 1)
    for i in range(width - 1, 0, -1):
        x, y = tree[2 * i], tree[2 * i + 1]
        tree[i] = x if x < y else y
    ahead, behind, merged = list(range(1, n + 1)), list(range(-1, n - 1)), rank

    def put(i: int, value: int) -> None:
        i += width
        tree[i] = value
        while i > 1:
            other = tree[i ^ 1]
            if other < value:
                value = other
            i >>= 1
            if tree[i] == value:
                return
            tree[i] = value

    while (root := tree[1]) != _NEVER:
        i = root & mask
        j = ahead[i]
        symbols[i] = merged[i] & 0xFFFFF
        symbols[j] = -1
        k = ahead[i] = ahead[j]
        if k < n:
            behind[k] = i
            merged[i] = r = look(symbols[i] << 32 | symbols[k], _NEVER)
            put(i, _NEVER if r == _NEVER else r >> 20 << bits | i)
        else:
            put(i, _NEVER)
        if j < n - 1:
            put(j, _NEVER)
        h = behind[i]
        if h >= 0:
            merged[h] = r = look(symbols[h] << 32 | symbols[i], _NEVER)
            put(h, _NEVER if r == _NEVER else r >> 20 << bits | h)
    return [s for s in symbols if s >= 0]


class _Kept(dict):
    """A bounded memo: what is missing is made, and all is forgotten when it is full."""

    def __init__(self, make):
        self.make = make

    def __missing__(self, key):
        value = self.make(key)
        if len(key) <= 64:
            if len(self) >= CACHE_ENTRIES:
                self.clear()
            self[key] = value
        return value


class ByteBpe:
    """A byte-level BPE vocabulary file of the tokenizers library."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, alphabet = spec["model"]["vocab"], byte_alphabet()
        back = {c: b for b, c in enumerate(alphabet)}
        self.byte_ids = [vocab[c] for c in alphabet]
        self.pair_of: dict[int, int] = {}
        for rank, pair in enumerate(spec["model"]["merges"]):
            left, right = pair.split(" ") if isinstance(pair, str) else pair
            self.pair_of[vocab[left] << 32 | vocab[right]] = rank << 20 | vocab[left + right]
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.bytes_of = [b""] * (1 + max([*vocab.values(), *self.special.values()]))
        for token, i in vocab.items():
            self.bytes_of[i] = bytes(back[c] for c in token)
        for token, i in self.special.items():
            self.bytes_of[i] = token.encode()
        self._special_split = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")").split if self.special else None
        self._piece, self._chunk = _Kept(self._encode_piece), _Kept(self._encode_chunk)

    def _encode_piece(self, piece: str) -> bytes:
        ids = self.byte_ids
        return array("I", merge_pairs([ids[b] for b in piece.encode()], self.pair_of)).tobytes()

    def _encode_chunk(self, chunk: str) -> bytes:
        known = self._piece
        return b"".join([known[p] for p in _pieces(chunk)])

    def _encode_plain(self, text: str) -> bytes:
        """A piece never spans the place before a blank that a visible character follows; so texts are cut there and the chunks kept."""
        known = self._chunk
        if _odd_blank(text):
            return b"".join([known[c] for c in _before_word(text) if c])
        chunks = text.replace(" ", "\0 ").split("\0") if "\0" not in text else _before_word(text)
        return b"".join([known[c] for c in chunks if c])

    def encode(self, text: str | None) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        if not text:
            return b""
        if self._special_split is None or not any(s in text for s in self.special):
            return self._encode_plain(text)
        return b"".join(array("I", [self.special[x]]).tobytes() if x in self.special else self._encode_plain(x) for x in self._special_split(text) if x)

    def decode(self, ids: bytes) -> str:
        table = self.bytes_of
        return b"".join([table[i] for i in np.frombuffer(ids, "<u4").tolist()]).decode("utf-8", "replace")


@lru_cache(maxsize=4)
def tokenizer(path: str) -> ByteBpe:
    """One per worker and file."""
    return ByteBpe(path)


def encode(docs: DataFrame, path: str, text: str = "text", id: str = "doc_id") -> DataFrame:
    """``(id, ids binary)``: every whole text's ids as little-endian unsigned 32-bit integers.

    Null and empty texts give no ids; repeated rows stay; other columns are left out.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bpe = tokenizer(path)
        for x in batches:
            yield pd.DataFrame({"id": x["id"], "ids": [bpe.encode(t) for t in x["text"]]})

    kind = docs.schema[id].dataType.simpleString()
    return docs.select(docs[id].alias("id"), text_of(text).alias("text")).mapInPandas(run, f"id {kind}, ids binary").withColumnRenamed("id", id)


def decode(encoded: DataFrame, path: str, ids: str = "ids", id: str = "doc_id") -> DataFrame:
    """``(id, text)``: the inverse of :func:`encode`. Null ids give null."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bpe = tokenizer(path)
        for x in batches:
            yield pd.DataFrame({"id": x["id"], "text": [None if i is None else bpe.decode(bytes(i)) for i in x["ids"]]})

    kind = encoded.schema[id].dataType.simpleString()
    return encoded.select(encoded[id].alias("id"), encoded[ids].alias("ids")).mapInPandas(run, f"id {kind}, text string").withColumnRenamed("id", id)


def round_trip(docs: DataFrame, path: str) -> DataFrame:
    """``(doc_id, n_tokens, ids_sha256, decoded_sha256)`` in one pass: encode, then decode those ids.

    One row for each row, in any order; null texts count as empty (no tokens);
    null and repeated doc_ids stay as they are; no shuffle.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bpe = tokenizer(path)
        for x in batches:
            ids = [bpe.encode(t) for t in x["text"]]
            yield pd.DataFrame(
                {
                    "doc_id": x["doc_id"],
                    "n_tokens": [len(i) // 4 for i in ids],
                    "ids_sha256": [hashlib.sha256(i).hexdigest() for i in ids],
                    "decoded_sha256": [hashlib.sha256(bpe.decode(i).encode()).hexdigest() for i in ids],
                }
            )

    return docs.select("doc_id", text_of().alias("text")).mapInPandas(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
