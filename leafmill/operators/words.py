"""Recognised words: merging two passes, lines, confidence.

A pass is a relation ``(page_id, idx, text, confidence, x0, y0, x1, y1)`` where
``idx`` is the word's place in its pass.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafmill.functions.text import half_up, has_indic_text, is_junk, is_latin_only, js_trim
from leafmill.operators import passes
from leafmill.operators.passes import BOX

OVERLAP, LATIN_BIAS, RECOVERED_FROM = 0.35, 8.0, 60.0


def iou_candidates(left: DataFrame, right: DataFrame, least: float = OVERLAP) -> DataFrame:
    """``(page_id, a_idx, b_idx, iou)`` of all pairs of a page that overlap by more than ``least``."""
    return passes.overlaps(passes.beside(left, right, ("idx",), BOX), least)


#: Most words: Latin letters and digits, and one mark after them at most. They are Latin, not Indic and no junk.
_PLAIN = r"\A[0-9A-Za-z\x{c0}-\x{d6}\x{d8}-\x{f6}\x{f8}-\x{ff}]+[.,;:!?]?\z"


def judged(words: DataFrame) -> DataFrame:
    """``words`` with ``kind``, what merging asks of their texts: whether they are Indic, Latin only, junk."""
    kind = sum(judge("text").cast("int") * bit for judge, bit in ((has_indic_text, passes.INDIC), (is_latin_only, passes.LATIN), (is_junk, passes.JUNK)))
    return words.withColumn("kind", F.when(F.col("text").rlike(_PLAIN), F.lit(passes.LATIN)).otherwise(kind))


def merge_passes(indic: DataFrame, latin: DataFrame) -> DataFrame:
    """``(page_id, ordinal, text, confidence, x0, y0, x1, y1, source, noise)``: the Indic pass with the Latin one's better readings.

    Indic words take, in their order, the unused Latin word of greatest overlap
    (the earliest of equals) if it is above 0.35. An Indic text stays and uses
    nothing up; any other gives way to a Latin text whose confidence is at most 8
    less. Latin words that overlap no Indic one are recovered if they are Latin,
    sure and no junk. Words are in reading order: lines by their middles, then
    from left to right, as :func:`reading_order` has them.
    """
    return merge_beside(passes.beside(judged(indic), judged(latin), ("idx", "text", "kind"), ("confidence", *BOX)))


def merge_beside(rows: DataFrame) -> DataFrame:
    """:func:`merge_passes` of judged words that stand side by side, those of a page together."""
    return passes.merge(rows, OVERLAP, LATIN_BIAS, RECOVERED_FROM)


def recovered(indic: DataFrame, latin: DataFrame, used: DataFrame | None = None, overlaps: DataFrame | None = None) -> DataFrame:
    """Words of the Latin pass that overlap no Indic one by more than 0.35 and are Latin, sure (60) and no junk.

    ``overlaps`` are the passes' :func:`iou_candidates`, if they are known; ``used`` are words that were taken already.
    """
    good = latin.where(is_latin_only("text") & (F.coalesce("confidence", F.lit(0.0)) >= RECOVERED_FROM) & ~is_junk("text"))
    taken = (iou_candidates(indic, good) if overlaps is None else overlaps).select("page_id", F.col("b_idx").alias("idx"))
    if used is not None:
        taken = taken.unionByName(used.select("page_id", F.col("b_idx").alias("idx")))
    return good.join(taken.distinct(), ["page_id", "idx"], "left_anti")


def _middle() -> Column:
    return (F.col("y0") + F.col("y1")) / 2


def line_breaks(words: DataFrame, *order: str) -> DataFrame:
    """``words`` with ``line``, from 0: a new one begins where the middle moves by more than 6 and 0.55 of the word's height."""
    w = Window.partitionBy("page_id").orderBy(*order)
    moved = F.abs(_middle() - F.lag(_middle()).over(w)) > F.greatest(F.lit(6.0), (F.col("y1") - F.col("y0")) * 0.55)
    marked = words.withColumn("new", F.coalesce(moved, F.lit(False)).cast("int"))
    return marked.withColumn("line", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("int")).drop("new")


def reading_order(words: DataFrame, *tie: str) -> DataFrame:
    """``words`` with ``ordinal`` from 0: by line (after sorting by middles), then x0, then text.

    A pairwise comparison of middles within a tolerance isn't transitive; lines
    make it a total order.
    """
    mids = words.withColumn("mid", _middle())
    lined = line_breaks(mids, "mid", "x0", "text", *tie)
    w = Window.partitionBy("page_id").orderBy("line", "x0", "text", *tie)
    return lined.withColumn("ordinal", (F.row_number().over(w) - 1).cast("int")).drop("mid", "line")


def lines(words: DataFrame, order: str = "ordinal", keep_blank: bool = False) -> DataFrame:
    """``(page_id, line, line_text)``: words joined by blanks; noise is left out, and blank words unless they are kept for display."""
    kept = words if "noise" not in words.columns else words.where(~F.coalesce("noise", F.lit(False)))
    kept = kept if keep_blank else kept.where(F.coalesce(js_trim("text"), F.lit("")) != "")
    parts = F.transform(F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), "text"))), lambda s: s["text"])
    return line_breaks(kept, order).groupBy("page_id", "line").agg(js_trim(F.array_join(parts, " ")).alias("line_text"))


def page_text(words: DataFrame, order: str = "ordinal") -> DataFrame:
    """``(page_id, text)``: lines joined by line feeds, empty ones left out."""
    own = lines(words, order).where("line_text <> ''")
    return own.groupBy("page_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("line", "line_text"))), lambda s: s["line_text"]), "\n").alias("text"))


def page_confidence(words: DataFrame) -> DataFrame:
    """``(page_id, confidence, n_words, n_low)``: the mean with null as 0, noise included; words below 72."""
    sure = F.coalesce("confidence", F.lit(0.0))
    return words.groupBy("page_id").agg(F.avg(sure).alias("confidence"), F.count("*").alias("n_words"), F.count_if(sure < 72).alias("n_low"))


def document_confidence(pages: DataFrame) -> DataFrame:
    """``(docId, just_read, stored)``: the mean over pages that have one (0 if none has), and the sum over all pages."""
    sure = F.coalesce("confidence", F.lit(0.0))
    return pages.groupBy("docId").agg(F.coalesce(F.avg(F.when(sure != 0, sure)), F.lit(0.0)).alias("just_read"), (F.sum(sure) / F.count("*")).alias("stored"))


def rounded(confidence: Column) -> Column:
    return half_up(F.coalesce(confidence, F.lit(0.0)))
