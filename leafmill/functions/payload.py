"""What a barcode's payload says."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def parse_code_value(raw: Column) -> Column:
    """``struct<kind, payee, vpa, amount, note, ssid, name, value>``; fields of other kinds are null.

    Kinds are tried in this order: upi, url, wifi, contact, phone or email, text.
    Parameters of a payment are decoded; a missing one is empty.
    """
    query = F.coalesce(F.nullif(F.regexp_extract(raw, r"(?s)\A[^?]*\?([^?]*)", 1), F.lit("")), F.lit(""))

    def parameter(name: str) -> Column:
        value = F.regexp_extract(query, rf"(?s)(?:\A|&){name}=([^&]*)", 1)
        return F.coalesce(F.try_url_decode(value), value)

    lower = F.lower(raw)
    kind = (
        F.when(raw.isNull() | (raw == ""), "text")
        .when(lower.startswith("upi://"), "upi")
        .when(raw.rlike(r"\A(?i:https?:)?//"), "url")
        .when(lower.startswith("wifi:"), "wifi")
        .when(lower.startswith("begin:vcard"), "contact")
        .when(lower.startswith("tel:"), "phone")
        .when(lower.startswith("mailto:"), "email")
        .otherwise("text")
    )
    of = lambda k, v: F.when(kind == k, v)
    return F.struct(
        kind.alias("kind"),
        of("upi", parameter("pn")).alias("payee"),
        of("upi", parameter("pa")).alias("vpa"),
        of("upi", parameter("am")).alias("amount"),
        of("upi", parameter("tn")).alias("note"),
        of("wifi", F.regexp_extract(raw, r"S:([^;]*)", 1)).alias("ssid"),
        of("contact", F.trim(F.regexp_extract(raw, r"\n(?i:FN):([^\n\r]*)", 1))).alias("name"),
        raw.alias("value"),
    )
