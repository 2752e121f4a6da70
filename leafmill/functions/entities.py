"""Entities of Indian documents: twelve patterns, a checksum, and the resolution of overlaps.

Two forms with the same rules for words' edges as ASCII: ``extract`` finds all
kinds with their places and resolves overlaps in Arrow batches; ``values`` finds
one kind with built-in expressions, without resolution.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

from leafmill.functions.text import dihedral, verhoeff_valid
from leafmill.schemas import ENTITY

# Bank handles of payment addresses.
HANDLES = "okaxis oksbi okhdfcbank okicici paytm ybl ibl axl apl upi abfspay airtel freecharge jupiteraxis fam slc yesg dbs idfcbank indus kotak sbi hdfcbank icici axisbank".split()

_L, _R = r"(?:(?<![A-Za-z0-9_])(?=[A-Za-z0-9_])|(?<=[A-Za-z0-9_])(?![A-Za-z0-9_]))", r"(?:(?<![A-Za-z0-9_])(?=[A-Za-z0-9_])|(?<=[A-Za-z0-9_])(?![A-Za-z0-9_]))"
_S = "[\t-\r    -     　﻿]"
_NOT_URL = "\t-\r    -     　﻿<>\"')\\]"


class Kind(NamedTuple):
    type: str
    label: str
    priority: int
    pattern: str
    any_case: bool = False
    sensitive: bool = False


# Kinds in the order that breaks ties, with their priorities and grammars.
KINDS = (
    Kind("email", "Email", 7, rf"{_L}[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{{2,}}{_R}"),
    Kind("url", "Link", 6, rf"{_L}(?:https?://|www\.)[^{_NOT_URL}]+", True),
    Kind("upi", "UPI ID", 10, rf"{_L}[a-zA-Z0-9._-]{{2,}}@(?:{'|'.join(HANDLES)}){_R}", True),
    Kind("phone", "Phone", 5, rf"(?:\+91(?:-|{_S})?|{_L}0)?[6-9][0-9]{{4}}(?:-|{_S})?[0-9]{{5}}{_R}"),
    Kind("pan", "PAN", 8, rf"{_L}[A-Z]{{5}}[0-9]{{4}}[A-Z]{_R}", False, True),
    Kind("gstin", "GSTIN", 9, rf"{_L}[0-9]{{2}}[A-Z]{{5}}[0-9]{{4}}[A-Z][A-Z0-9]Z[A-Z0-9]{_R}"),
    Kind("ifsc", "IFSC", 8, rf"{_L}[A-Z]{{4}}0[A-Z0-9]{{6}}{_R}"),
    Kind("aadhaar", "Aadhaar", 9, rf"{_L}[2-9][0-9]{{3}}(?:-|{_S})?[0-9]{{4}}(?:-|{_S})?[0-9]{{4}}{_R}", False, True),
    Kind("vehicle", "Vehicle", 5, rf"{_L}[A-Z]{{2}}(?:-|{_S})?[0-9]{{1,2}}(?:-|{_S})?[A-Z]{{1,3}}(?:-|{_S})?[0-9]{{4}}{_R}"),
    Kind("amount", "Amount", 4, rf"(?:₹|{_L}Rs\.?|{_L}INR){_S}?[0-9][0-9,]*(?:\.[0-9]{{1,2}})?{_R}", True),
    Kind("pincode", "PIN code", 1, rf"{_L}[1-9][0-9]{{5}}{_R}"),
    Kind("date", "Date", 3, rf"{_L}(?:[0-9]{{1,2}}[/.-][0-9]{{1,2}}[/.-][0-9]{{2,4}}|[0-9]{{1,2}}{_S}+(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)[a-z]*{_S}+[0-9]{{2,4}}){_R}", True),
)
BY_TYPE = {k.type: k for k in KINDS}


#: The same for Python, where ASCII word edges have a short and fast form; with what each kind can't do without.
_COMPILED = [(order, k, re.compile(k.pattern.replace(_L, r"\b"), re.ASCII | (re.IGNORECASE if k.any_case else 0)), {"email": "@", "upi": "@"}.get(k.type)) for order, k in enumerate(KINDS)]
_digit = re.compile("[0-9]").search


def _java(kind: Kind) -> str:
    """ASCII case only, in both engines."""
    return f"(?i:{kind.pattern})" if kind.any_case else kind.pattern


def values(text: Column, type: str) -> Column:
    """All matches of one kind, in order, as an array of strings; checked where the kind has a check."""
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(_java(BY_TYPE[type])), F.lit(0))
    return F.filter(found, verhoeff_valid) if type == "aadhaar" else found


def href(type: Column, value: Column) -> Column:
    """The link that acting on an entity opens, null for those that are only copied."""
    return (
        F.when(type == "email", F.concat(F.lit("mailto:"), value))
        .when(type == "url", F.when(value.startswith("http"), value).otherwise(F.concat(F.lit("https://"), value)))
        .when(type == "phone", F.concat(F.lit("tel:"), F.regexp_replace(value, "[^0-9+]", "")))
    )


def _checked(digits: str) -> bool:
    step, c = [1, 5, 7, 6, 2, 8, 3, 0, 9, 4], 0
    own = [int(d) for d in digits if "0" <= d <= "9"]
    if len(own) != 12:
        return False
    for i, d in enumerate(reversed(own)):
        for _ in range(i % 8):
            d = step[d]
        c = dihedral(c, d)
    return c == 0


def resolve(text: str | None) -> list[dict]:
    """Entities of a text by place: the longest first, then the higher priority, then the order of kinds and places; none overlaps another."""
    if not text:
        return []
    found, digits = [], _digit(text) is not None
    for order, k, pattern, needs in _COMPILED:
        if needs not in text if needs else k.type != "url" and not digits:
            continue
        for m in pattern.finditer(text):
            if k.type != "aadhaar" or _checked(m.group()):
                found.append((m.start() - m.end(), -k.priority, order, m.start(), m.end(), m.group()))
    # what is taken never overlaps, so only the neighbours of a place need a look
    taken: list[tuple[int, int, int, str]] = []
    for _, _, order, start, end, value in sorted(found):
        i = bisect_left(taken, (start, end))
        if (i == 0 or taken[i - 1][1] <= start) and (i == len(taken) or end <= taken[i][0]):
            taken.insert(i, (start, end, order, value))
    out = []
    for start, end, order, value in taken:
        k = KINDS[order]
        value = re.sub(rf"\A{_S}+|{_S}+\Z", "", value)
        link = {"email": f"mailto:{value}", "url": value if value.startswith("http") else f"https://{value}", "phone": "tel:" + re.sub(r"[^0-9+]", "", value)}.get(k.type)
        out.append({"type": k.type, "label": k.label, "value": value, "start": start, "end": end, "sensitive": k.sensitive, "href": link})
    return out


@F.pandas_udf(ArrayType(ENTITY))
def extract(text: pd.Series) -> pd.Series:
    """Resolved entities of each text; null and empty texts have none."""
    return text.map(resolve)


def group_entities(entities: DataFrame, *keys: str) -> DataFrame:
    """Rows of ``(*keys, type, value, start, label, sensitive, href)`` as one for each type and value of a key.

    With their ``count`` and the first one's other fields; ``ordinal`` numbers
    them within the key by first appearance, from 0.
    """
    first = F.min_by(F.struct("label", "sensitive", "href"), "start")
    groups = entities.groupBy(*keys, "type", "value").agg(F.count("*").alias("count"), F.min("start").alias("start"), first.alias("f"))
    order = Window.partitionBy(*keys).orderBy("start", "type", "value")
    return groups.withColumn("ordinal", F.row_number().over(order) - 1).select(*keys, "ordinal", "type", "value", "count", "start", "f.label", "f.sensitive", "f.href")


def export_lines(groups: DataFrame, *keys: str) -> DataFrame:
    """``(*keys, text)``: a line ``Label: value`` for each group, in order."""
    line = F.struct("ordinal", F.concat_ws(": ", "label", "value").alias("line"))
    return groups.groupBy(*keys).agg(F.array_join(F.transform(F.sort_array(F.collect_list(line)), lambda s: s["line"]), "\n").alias("text"))
