"""Text predicates and formats, all as built-in expressions.

Lengths and offsets count code points. White space means the characters that
JavaScript's ``\\s`` matches, spelled out, as the engine's own class has fewer.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from leafmill.schemas import LANGUAGES, SCRIPTS

# White space, and the edges of ASCII words.
SPACE = r"\t-\r    -     　﻿"
WORD_START, WORD_END = r"(?<![A-Za-z0-9_])(?=[A-Za-z0-9_])", r"(?<=[A-Za-z0-9_])(?![A-Za-z0-9_])"


def _text(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def js_trim(x: Column | str) -> Column:
    return F.regexp_replace(_text(x), rf"\A[{SPACE}]+|[{SPACE}]+\z", "")


def half_up(x: Column) -> Column:
    """Rounds halves towards positive infinity."""
    return F.floor(x + 0.5)


def _class(ranges) -> str:
    return "".join(rf"\x{{{a:x}}}-\x{{{b:x}}}" for a, b in ranges)


_NON_LATIN = _class(r for key, _, rs in SCRIPTS if key != "latin" for r in rs)


def script_of(ch: Column | str) -> Column:
    """Script of the first character, null where it has none."""
    point = F.ascii(_text(ch))
    out = F.when(F.lit(False), F.lit(""))
    for key, _, ranges in SCRIPTS:
        for a, b in ranges:
            out = out.when(point.between(a, b), key)
    return out


def script_name(key: Column | str) -> Column:
    names = F.create_map(*(F.lit(x) for k, n, _ in SCRIPTS for x in (k, n)))
    return names[_text(key)]


def script_counts(text: Column | str) -> Column:
    """``array<struct<n, script>>`` of the scripts that occur, in the order of their first characters.

    Most texts have Latin letters alone: one test decides whether the others are counted.
    """
    t = F.coalesce(_text(text), F.lit(""))
    found = {}
    for key, _, ranges in SCRIPTS:
        own = f"[{_class(ranges)}]"
        n = F.regexp_count(t, F.lit(own))
        first = F.length(F.regexp_extract(t, f"(?s)\\A[^{_class(ranges)}]*", 0))
        found[key] = F.when(n > 0, F.struct(first.alias("first"), n.alias("n"), F.lit(key).alias("script")))
    some = F.when(has_indic_text(t), F.array(*found.values())).otherwise(F.array(found["latin"]))
    return F.transform(F.array_sort(F.array_compact(some)), lambda s: F.struct(s["n"].alias("n"), s["script"].alias("script")))


def _most(counts: Column) -> Column:
    """The script of the greatest count, the first one of equals."""
    best = F.array_max(F.transform(counts, lambda s: s["n"]))
    return F.get(F.filter(counts, lambda s: s["n"] == best), F.lit(0))["script"]


def dominant_script(text: Column | str) -> Column:
    return _most(script_counts(text))


def dominant_indic_script_name(text: Column | str) -> Column:
    """Display name of the dominant script other than Latin, null if there is none."""
    return script_name(_most(F.filter(script_counts(text), lambda s: s["script"] != "latin")))


def has_indic_text(text: Column | str) -> Column:
    """Any character of a script other than Latin, Perso-Arabic included."""
    return F.coalesce(_text(text), F.lit("")).rlike(f"[{_NON_LATIN}]")


def is_latin_only(text: Column | str) -> Column:
    """Printable ASCII, Latin supplements, general punctuation and the rupee sign only; true for empty texts."""
    return F.coalesce(_text(text), F.lit("")).rlike(r"\A[ -~\x{a0}-\x{24f}\x{2010}-\x{201f}\x{20b9}]*\z")


def can_transliterate(text: Column | str) -> Column:
    return F.coalesce(_text(text), F.lit("")).rlike(r"[\x{900}-\x{d7f}]")


def is_junk(text: Column | str) -> Column:
    """Whether a recognised word is noise: no letter, number or mark; mostly others in a longer one; or one character four times running."""
    t = js_trim(F.coalesce(_text(text), F.lit("")))
    good, length = F.regexp_count(t, F.lit(r"[\p{L}\p{N}\p{M}]")), F.length(t)
    share = F.try_divide(good, length)
    return (length == 0) | (good == 0) | ((length > 3) & (share < 0.5)) | (t.rlike(r"(?s)(.)\1{3,}") & (share < 0.6))


#: Confidences below which a word is noise: an Indic one, and any other.
UNSURE_INDIC, UNSURE = 12, 40


def is_noise(text: Column | str, confidence: Column | str) -> Column:
    """Junk, or too little confidence for its script: 12 for Indic words, 40 for others. Null confidence is 0."""
    sure = F.coalesce(_text(confidence), F.lit(0.0))
    return is_junk(text) | F.when(has_indic_text(text), sure < UNSURE_INDIC).otherwise(sure < UNSURE)


def low_confidence(confidence: Column | str) -> Column:
    return F.coalesce(_text(confidence), F.lit(0.0)) < 72


def confidence_band(mean: Column | str) -> Column:
    """``good`` from 85, ``neutral`` from 70, else ``warn``, of the rounded mean."""
    r = half_up(F.coalesce(_text(mean), F.lit(0.0)))
    return F.when(r >= 85, "good").when(r >= 70, "neutral").otherwise("warn")


def has_text(text: Column | str) -> Column:
    return F.coalesce(js_trim(text), F.lit("")) != ""


def known_languages(codes: Column | str) -> Column:
    """Known codes once each in their order; ``eng`` alone if there is none."""
    known = F.array(*(F.lit(x[0]) for x in LANGUAGES))
    kept = F.array_distinct(F.filter(F.coalesce(_text(codes), F.array().cast("array<string>")), lambda c: F.array_contains(known, c)))
    return F.when(F.size(kept) > 0, kept).otherwise(F.array(F.lit("eng")))


def non_latin_languages(codes: Column | str) -> Column:
    latin = F.array(*(F.lit(x[0]) for x in LANGUAGES if x[3] == "latin"))
    return F.array_except(known_languages(codes), latin)


def source_iso(codes: Column | str) -> Column:
    """ISO code of the first known language that isn't Latin, else ``en``."""
    iso = F.create_map(*(F.lit(x) for c, i, _, s, _ in LANGUAGES if s != "latin" for x in (c, i)))
    found = F.filter(F.coalesce(_text(codes), F.array().cast("array<string>")), lambda c: iso[c].isNotNull())
    return F.coalesce(iso[F.get(found, F.lit(0))], F.lit("en"))


def language_name(iso: Column | str) -> Column:
    """Name of an ISO code, or the code in upper case."""
    names = F.create_map(*(F.lit(x) for _, i, n, _, _ in LANGUAGES for x in (i, n)))
    return F.coalesce(names[_text(iso)], F.upper(_text(iso)))


def with_language(codes: Column | str, code: str, selected: bool) -> Column:
    """The list with a language added at its end or taken out."""
    own = F.coalesce(_text(codes), F.array().cast("array<string>"))
    one = F.array(F.lit(code))
    return F.array_union(own, one) if selected else F.array_except(own, one)


def is_sanskrit_only(codes: Column | str) -> Column:
    """Whether every language that isn't Latin is Sanskrit, and there is one: then no vowel is dropped."""
    others = non_latin_languages(codes)
    return (F.size(others) > 0) & F.forall(others, lambda c: c == "san")


def is_image_mime(mime: Column | str) -> Column:
    return F.coalesce(_text(mime), F.lit("")).startswith("image/")


def normalise_query(q: Column | str) -> Column:
    return F.lower(js_trim(q))


def snippet(text: Column | str, query: Column | str) -> Column:
    """From 40 characters before the first match to 60 after it, white space collapsed; an ellipsis before it if cut, and always after it."""
    t, q = _text(text), _text(query)
    at = F.instr(F.lower(t), q) if isinstance(query, str) else F.call_function("locate", q, F.lower(t))
    start = F.greatest(F.lit(0), at - 1 - 40)
    end = F.least(F.length(t), at - 1 + F.length(q) + 60)
    cut = F.regexp_replace(F.substring(t, start + 1, end - start), rf"[{SPACE}]+", " ")
    return F.concat(F.when(start > 0, "…").otherwise(""), cut, F.lit("…"))


def highlight(text: Column | str, query: str, opening: str = "<mark>", closing: str = "</mark>") -> Column:
    """Every occurrence in either case between the two marks."""
    if not query:
        return _text(text)
    quoted = r"\Q" + query.replace(r"\E", r"\E\\E\Q") + r"\E"
    return F.regexp_replace(_text(text), f"(?iu)({quoted})", f"{opening}$1{closing}")


# Characters that markup escapes, and the order in which a provider's text is unescaped.
ESCAPES = (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;"))
UNESCAPES = (("&#39;", "'"), ("&quot;", '"'), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"))


def _replace_all(x: Column, pairs) -> Column:
    for a, b in pairs:
        x = F.replace(x, F.lit(a), F.lit(b))
    return x


def escape_html(text: Column | str) -> Column:
    return _replace_all(F.coalesce(_text(text), F.lit("")), ESCAPES)


def unescape_html(text: Column | str) -> Column:
    return _replace_all(_text(text), UNESCAPES)


def safe_name(title: Column | str) -> Column:
    """A file name: word characters, Indic letters, blanks and hyphens; 60 characters at most; ``scan`` if none is left."""
    kept = F.substring(js_trim(F.regexp_replace(F.coalesce(_text(title), F.lit("")), r"[^A-Za-z0-9_\x{900}-\x{dff} -]+", "")), 1, 60)
    return F.coalesce(F.nullif(kept, F.lit("")), F.lit("scan"))


def slug(path: Column | str) -> Column:
    """Runs of other characters than ASCII letters and digits as one hyphen, none at either end."""
    return F.regexp_replace(F.regexp_replace(_text(path), "[^A-Za-z0-9]+", "-"), r"\A-+|-+\z", "")


def grapheme_clusters(text: Column | str) -> Column:
    return F.regexp_extract_all(F.coalesce(_text(text), F.lit("")), F.lit(r"\X"), F.lit(0))


def pdf_text_string(text: Column | str) -> Column:
    """UTF-16BE in hexadecimal with its byte-order mark, between angle brackets."""
    return F.concat(F.lit("<feff"), F.lower(F.hex(F.encode(F.coalesce(_text(text), F.lit("")), "UTF-16BE"))), F.lit(">"))


def translation_key(provider: Column | str, source: Column | str, target: Column | str, text: Column | str) -> Column:
    t = F.coalesce(_text(text), F.lit(""))
    return F.concat(_text(provider), F.lit(":"), _text(source), F.lit(">"), _text(target), F.lit(":"), F.length(t).cast("string"), F.lit(":"), F.substring(t, 1, 60))


def verhoeff_valid(value: Column | str) -> Column:
    """Whether the digits are twelve and end in their Verhoeff check digit.

    Both tables follow from rules: products of the dihedral group of order ten,
    and powers of one permutation.
    """
    product = [[dihedral(a, b) for b in range(10)] for a in range(10)]
    step, powers = [1, 5, 7, 6, 2, 8, 3, 0, 9, 4], [list(range(10))]
    for _ in range(7):
        powers.append([powers[-1][step[d]] for d in range(10)])
    table, turns = (F.array(*(F.lit(v) for row in rows for v in row)) for rows in (product, powers))
    digits = F.reverse(F.regexp_replace(F.coalesce(_text(value), F.lit("")), "[^0-9]", ""))
    check = F.aggregate(F.sequence(F.lit(0), F.lit(11)), F.lit(0), lambda c, i: F.get(table, c * 10 + F.get(turns, i % 8 * 10 + F.coalesce(F.substring(digits, i + 1, F.lit(1)).cast("int"), F.lit(0)))))
    return (F.length(digits) == 12) & (check == 0)


def dihedral(a: int, b: int) -> int:
    """Rotations are 0 to 4, reflections 5 to 9."""
    turn = (a + b) % 5 if a < 5 else (a - b) % 5
    return turn + (0 if (a < 5) == (b < 5) else 5)
