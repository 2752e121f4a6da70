"""Two passes over the same pages, side by side: their overlapping boxes, and the passes merged.

Rows are ``(page_id, idx, text, kind, a, a_x0, ..., b, b_x0, ...)``; ``a`` and
``b`` say whether the row has a word of that pass. Two words may share a row if
their places and texts are the same, which means nothing else. Rows of one page
stand together, so pages are finished one after the other and no word goes out
more than once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafmill.functions.text import UNSURE, UNSURE_INDIC

BOX = ("x0", "y0", "x1", "y1")
#: Rows of whole pages taken together, and pairs of boxes tried at once.
_ROWS, _PAIRS = 1 << 16, 1 << 20


def beside(left: DataFrame, right: DataFrame, shared: tuple[str, ...], own: tuple[str, ...]) -> DataFrame:
    """Two relations of words as rows of this module, those of a page together: every word is shuffled once."""

    def one(df: DataFrame, prefix: str) -> DataFrame:
        types = dict(df.dtypes)
        sides = (x for p in "ab" for x in (F.lit(p == prefix).alias(p), *((F.col(c) if p == prefix else F.lit(None).cast(types[c])).alias(f"{p}_{c}") for c in own)))
        return df.select("page_id", *shared, *sides)

    return one(left, "a").unionByName(one(right, "b")).repartition("page_id").sortWithinPartitions("page_id")


def _column(t: pa.Table, name: str) -> pa.Array:
    return pa.concat_arrays(t.column(name).chunks)


def _pages(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Whole pages, ``_ROWS`` rows or more, with each row's page by number."""

    def numbered(t: pa.Table) -> np.ndarray:
        code = _column(t, "page_id").dictionary_encode(null_encoding="encode").indices.to_numpy()
        return np.concatenate([[0], np.cumsum(code[1:] != code[:-1])])

    held, count, least = [], 0, _ROWS
    for x in batches:
        if not x.num_rows:
            continue
        held.append(x)
        count += x.num_rows
        if count >= least:
            t = pa.Table.from_batches(held)
            number = numbered(t)
            last = int(np.searchsorted(number, number[-1]))
            if last:
                yield t.slice(0, last), number[:last]
            held = t.slice(last).to_batches()
            count -= last
            least = max(_ROWS, 2 * count)
    if held:
        t = pa.Table.from_batches(held)
        yield t, numbered(t)


class _Pass:
    """The words of one pass: their rows, pages by number, places and boxes."""

    def __init__(self, t: pa.Table, number: np.ndarray, prefix: str):
        self.t = t
        self.rows = np.flatnonzero(_column(t, prefix).to_numpy(zero_copy_only=False))
        self.page, self.idx = number[self.rows], self.numbers("idx").astype(np.int64)
        self.box = np.stack([self.numbers(f"{prefix}_{c}", np.nan) for c in BOX]).astype(float)
        self.named = _column(t, "page_id").is_valid().to_numpy(zero_copy_only=False)[self.rows]

    def numbers(self, name: str, null=0) -> np.ndarray:
        column = _column(self.t, name)
        return (column if null != null else column.fill_null(null)).to_numpy(zero_copy_only=False)[self.rows]


def _overlapping(a: _Pass, b: _Pass, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(i, j, iou)`` of all words of ``a`` and ``b`` on one page that overlap by more than ``least``.

    Words of ``a`` are sorted by page, band of height and left edge. Where two
    boxes overlap by more than ``least``, so do their widths and their heights,
    so a word of ``b`` looks at few bands, and there at a range of edges.
    """
    some, other = (np.flatnonzero(p.named & np.isfinite(p.box).all(axis=0) & (p.box[2] > p.box[0]) & (p.box[3] > p.box[1])) for p in (a, b))
    nothing = np.array([], np.int64), np.array([], np.int64), np.array([])
    if not len(some) or not len(other):
        return nothing
    page, (x, y, x1, y1), (u, v, u1, v1) = a.page[some], a.box[:, some], b.box[:, other]
    names, at = np.unique(page, return_inverse=True)
    its = np.minimum(np.searchsorted(names, b.page[other]), len(names) - 1)
    met = names[its] == b.page[other]
    other, its, u, v, u1, v1 = (z[met] for z in (other, its, u, v, u1, v1))
    top, bottom, tall, wide = (np.full(len(names), z) for z in (np.inf, -np.inf, 0.0, 0.0))
    np.minimum.at(top, at, y)
    np.maximum.at(bottom, at, y)
    np.maximum.at(tall, at, y1 - y)
    np.maximum.at(wide, at, x1 - x)
    # no more bands than words
    step = np.maximum(tall, (bottom - top) / np.bincount(at))
    count = np.floor((bottom - top) / step).astype(np.int64) + 1
    base = np.cumsum(count) - count
    band = lambda z, p: np.clip(np.floor((z - top[p]) / step[p]), -1, count[p]).astype(np.int64)
    edges = np.sort(x)
    key = (base[at] + np.minimum(band(y, at), count[at] - 1)) * (len(x) + 1) + np.searchsorted(edges, x)
    order = np.argsort(key, kind="stable")
    key = key[order]
    # what is as much smaller or larger as the least overlap allows
    before = lambda size, most: np.minimum(most, size * (1 / least - 1)) if least > 0 else most
    slack = lambda p, q: 1e-9 * (np.abs(p) + np.abs(q) + 1)
    left, right = np.searchsorted(edges, u - before(u1 - u, wide[its]) - slack(u, u1)), np.searchsorted(edges, u1 - max(least, 0) * (u1 - u) + slack(u, u1))
    low = np.maximum(band(v - before(v1 - v, tall[its]) - slack(v, v1), its), 0)
    high = np.minimum(band(v1 - max(least, 0) * (v1 - v) + slack(v, v1), its), count[its] - 1)
    found = []
    going = np.flatnonzero((low <= high) & (left < right))
    while len(going):
        row = (base[its[going]] + low[going]) * (len(x) + 1)
        start, end = np.searchsorted(key, row + left[going]), np.searchsorted(key, row + right[going])
        hit = np.flatnonzero(end > start)
        own, start, size = going[hit], start[hit], (end - start)[hit]
        done = np.concatenate([[0], np.cumsum(size)])
        k = 0
        while k < len(own):
            to = max(k + 1, int(np.searchsorted(done, done[k] + _PAIRS, side="right")) - 1)
            j = np.repeat(own[k:to], size[k:to])
            i = order[np.repeat(start[k:to] - done[k:to], size[k:to]) + np.arange(done[k], done[to])]
            k = to
            w, h = np.minimum(x1[i], u1[j]) - np.maximum(x[i], u[j]), np.minimum(y1[i], v1[j]) - np.maximum(y[i], v[j])
            touch = (w > 0) & (h > 0)
            i, j, w, h = i[touch], j[touch], w[touch], h[touch]
            iou = w * h / ((x1[i] - x[i]) * (y1[i] - y[i]) + (u1[j] - u[j]) * (v1[j] - v[j]) - w * h)
            over = iou > least
            found.append((some[i[over]], other[j[over]], iou[over]))
        low[going] += 1
        going = going[low[going] <= high[going]]
    return tuple(np.concatenate(z) for z in zip(*found)) if found else nothing


def overlaps(rows: DataFrame, least: float) -> DataFrame:
    """``(page_id, a_idx, b_idx, iou)`` of all pairs of a page that overlap by more than ``least``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, number in _pages(batches):
            a, b = _Pass(t, number, "a"), _Pass(t, number, "b")
            i, j, iou = _overlapping(a, b, least)
            yield pa.RecordBatch.from_arrays([_column(t, "page_id").take(pa.array(a.rows[i])), pa.array(a.idx[i]), pa.array(b.idx[j]), pa.array(iou)], ["page_id", "a_idx", "b_idx", "iou"])

    kind = rows.schema["page_id"].dataType.simpleString()
    return rows.select("page_id", "idx", *(x for p in "ab" for x in (p, *(f"{p}_{c}" for c in BOX)))).mapInArrow(run, f"page_id {kind}, a_idx long, b_idx long, iou double")


def _chosen(a: _Pass, b: _Pass, i: np.ndarray, j: np.ndarray, iou: np.ndarray) -> np.ndarray:
    """For each word of ``a`` the word of ``b`` that it takes, or -1: in their order, the unused one of greatest overlap, the earliest of equals."""
    out = np.full(len(a.rows), -1)
    alone = (np.bincount(i, minlength=len(a.rows))[i] == 1) & (np.bincount(j, minlength=len(b.rows))[j] == 1)
    out[i[alone]] = j[alone]
    i, j, iou = i[~alone], j[~alone], iou[~alone]
    order = np.lexsort((b.idx[j], -iou, i, a.idx[i], a.page[i]))
    used = set()
    for p, q in zip(i[order].tolist(), j[order].tolist()):
        if out[p] < 0 and q not in used:
            used.add(q)
            out[p] = q
    return out


def _sorted(keys: list[np.ndarray], text: pa.Array, *last: np.ndarray) -> np.ndarray:
    """The order by ``keys``, then text, then ``last``; nulls (not numbers) first. Only the texts of equals are compared."""
    keys = [np.where(np.isnan(k), -np.inf, k) for k in keys]
    order = np.lexsort(keys[::-1])
    same = np.logical_and.reduce([k[order[1:]] == k[order[:-1]] for k in keys])
    if not same.any():
        return order
    tied = np.zeros(len(order), bool)
    tied[order[1:][same]] = tied[order[:-1][same]] = True
    own = text.take(pa.array(np.flatnonzero(tied))).to_pylist()
    # the engine compares texts as bytes
    place = {x: n for n, x in enumerate(sorted({x for x in own if x is not None}, key=str.encode))}
    rank = np.zeros(len(order), np.int64)
    rank[tied] = [-1 if x is None else place[x] for x in own]
    return np.lexsort((*last[::-1], rank, *keys[::-1]))


#: What a word's ``kind`` is the sum of.
INDIC, LATIN, JUNK = 1, 2, 4
_SOURCES = pa.array(["indic", "latin", "latin-recovered"])


def merge(rows: DataFrame, least: float, bias: float, recovered_from: float) -> DataFrame:
    """:func:`leafmill.operators.words.merge_passes`; words have their confidence and box, rows the ``text`` and its ``kind``."""
    fields = ["confidence", *BOX]

    def merged(t: pa.Table, number: np.ndarray) -> pa.RecordBatch:
        a, b = _Pass(t, number, "a"), _Pass(t, number, "b")
        sure, other = a.numbers("a_confidence"), b.numbers("b_confidence")
        kind, text = _column(t, "kind").to_numpy(), _column(t, "text")
        latin, junk = kind[b.rows] & LATIN > 0, kind[b.rows] & JUNK > 0
        i, j, iou = _overlapping(a, b, least)
        covered = np.zeros(len(b.rows), bool)
        covered[j] = True
        own = kind[a.rows[i]] & INDIC == 0
        match = _chosen(a, b, i[own], j[own], iou[own])
        at = np.flatnonzero(match >= 0)
        at = at[latin[match[at]] & (other[match[at]] + bias >= sure[at])]
        more = np.flatnonzero(latin & (other >= recovered_from) & ~junk & ~covered)
        row, source = a.rows.copy(), np.zeros(len(a.rows), np.int64)
        row[at], source[at] = b.rows[match[at]], 1
        row, source = np.concatenate([row, b.rows[more]]), np.concatenate([source, np.full(len(more), 2)])
        page, place, part = np.concatenate([a.page, b.page[more]]), np.concatenate([a.idx, b.idx[more]]), source == 2
        # values of the first pass, then those of the second one
        taken = pa.array(row + t.num_rows * (source > 0))
        out = {"text": text.take(pa.array(row))} | {c: pa.concat_arrays([_column(t, f"a_{c}"), _column(t, f"b_{c}")]).take(taken) for c in fields}
        x0, y0, y1 = (out[c].to_numpy(zero_copy_only=False) for c in ("x0", "y0", "y1"))
        middle = (y0 + y1) / 2
        order = _sorted([page.astype(float), middle, x0], out["text"], part, place)
        moved = np.abs(np.diff(middle[order])) > np.fmax(6.0, (y1 - y0) * 0.55)[order][1:]
        line = np.empty(len(order))
        line[order] = np.concatenate([[0], np.cumsum(moved | (np.diff(page[order]) != 0))])[: len(order)]
        order = _sorted([line, x0], out["text"], part, place)
        page = page[order]
        start = np.flatnonzero(np.concatenate([[True], page[1:] != page[:-1]])[: len(page)])
        ordinal = np.arange(len(page)) - np.repeat(start, np.diff(np.append(start, len(page))))
        values = {c: v.take(pa.array(order)) for c, v in out.items()}
        certain = values["confidence"].fill_null(0.0).to_numpy(zero_copy_only=False)
        row = row[order]
        noise = (kind[row] & JUNK > 0) | (certain < np.where(kind[row] & INDIC > 0, UNSURE_INDIC, UNSURE))
        page_id = _column(t, "page_id").take(pa.array(row))
        return pa.RecordBatch.from_arrays([page_id, pa.array(ordinal.astype(np.int32)), *values.values(), _SOURCES.take(pa.array(source[order])), pa.array(noise)], ["page_id", "ordinal", *values, "source", "noise"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, number in _pages(batches):
            yield merged(t, number)

    kind = rows.schema["page_id"].dataType.simpleString()
    rows = rows.select("page_id", "idx", "text", "kind", *(x for p in "ab" for x in (p, *(f"{p}_{c}" for c in fields))))
    return rows.mapInArrow(run, f"page_id {kind}, ordinal int, text string, confidence double, x0 double, y0 double, x1 double, y1 double, source string, noise boolean")
