"""Cutting texts into chunks for a service that takes short ones, and putting its answers together."""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from leafmill.functions.text import translation_key

LIMIT = 450
# Ends of sentences.
ENDS = ("। ", ". ", "? ", "! ")
_A_BLANK, _SENTENCE_END = re.compile(" "), re.compile("|".join(map(re.escape, ENDS)))
_BLANK = "\t\n\v\f\r                 　  ﻿"
_BLANK_LINES, _FILLED_LINES = re.compile(rf"^[{_BLANK}]+$".replace("\n", ""), re.MULTILINE), re.compile(r"^[^\n]+$", re.MULTILINE)


def chunk_text(text: str | None, limit: int = LIMIT) -> list[str]:
    """Whole lines together up to ``limit``; a longer line is cut after the last end of a sentence, else a blank, in the second three fifths of the limit, else at the limit.

    As a cut takes the character that it ends at, a piece without any blank has
    one more than ``limit``. Blank lines stay as line feeds within a chunk.

    Chunks are slices: blank lines are emptied first, then each chunk reaches
    from where the last one ended to the furthest place that may end it.
    """
    whole = _BLANK_LINES.sub("", text or "")
    lines = [m.span() for m in _FILLED_LINES.finditer(whole)]
    begins, ends = [x for x, _ in lines], [x for _, x in lines]
    # the first character of what may end a piece of a long line, best kind first, and how many more it needs
    places = [([m.start() for m in p.finditer(whole)], more) for p, more in ((_SENTENCE_END, 1), (_A_BLANK, 0))]
    chunks, at = [], begins[0] if lines else len(whole)
    while at < len(whole):
        line = bisect_right(begins, at) - 1
        if ends[line] - at <= limit:
            after = bisect_right(ends, at + limit)
            to = begins[after] - 1 if after < len(lines) else len(whole)
            own, at = whole[at:to], to + 1
        else:
            last = (found[k] for found, more in places if (k := bisect_right(found, at + limit - 1 - more) - 1) >= 0 and found[k] >= at + limit * 0.4)
            to = next(last, at + limit) + 1
            own, at = whole[at:to].strip(_BLANK), to
            if at == ends[line]:
                at = begins[line + 1] if line + 1 < len(lines) else len(whole)
            chunks.append(own)
            continue
        if own.strip(_BLANK):
            chunks.append(own)
    return chunks


@F.pandas_udf(ArrayType(StringType()))
def chunks(text: pd.Series) -> pd.Series:
    return text.map(chunk_text)


Translator = Callable[[str, str, str], str]


class TranslationError(ValueError):
    pass


def translate(rows: DataFrame, translator: Translator | None, target: str, consent: bool = False, id: str = "id") -> DataFrame:
    """``(id, text, source)`` -> ``(id, translation, error)``, one row for each row.

    Nothing leaves the process without a translator that the caller gives and
    ``consent``. Empty texts give empty ones, a text in the target language
    itself; chunks go one after the other and are joined by line feeds; what the
    translator raises becomes that row's ``error``.
    """
    if translator is None or not consent:
        raise TranslationError("translation needs a translator and consent")
    if not target:
        raise TranslationError("choose a language to translate into")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            out = []
            for i, text, source in zip(x["id"], x["text"], x["source"]):
                if not text or not text.strip(_BLANK):
                    out.append((i, "", None))
                elif source == target:
                    out.append((i, text, None))
                else:
                    try:
                        out.append((i, "\n".join([translator(c, source, target) for c in chunk_text(text)]), None))
                    except Exception as e:  # noqa: BLE001 - a service may fail in any way
                        out.append((i, None, str(e)))
            yield pd.DataFrame(out, columns=["id", "translation", "error"], dtype=object)

    kind = rows.schema[id].dataType.simpleString()
    return rows.select(rows[id].alias("id"), "text", "source").mapInPandas(run, f"id {kind}, translation string, error string").withColumnRenamed("id", id)


def with_memo(rows: DataFrame, memo: DataFrame, provider: str, target: str) -> tuple[DataFrame, DataFrame]:
    """``(id, text, source)`` parted by ``memo(memo_key, translation)``: those that are known, with their translation, and the rest.

    One row for each row in all; a memo that repeats a key gives its least translation.
    """
    key = translation_key(F.lit(provider), F.coalesce("source", F.lit("")), F.lit(target), F.col("text"))
    once = memo.groupBy("memo_key").agg(F.min("translation").alias("translation"))
    joined = rows.withColumn("memo_key", key).join(once, "memo_key", "left")
    return joined.where("translation is not null"), joined.where("translation is null").drop("translation")
