from pyspark.sql import functions as F

from leafmill.functions import chunks, dates, entities, payload, text, translit


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def col(spark, f, values, kind="string"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[0] for r in rows.orderBy("i").select(f(F.col("v"))).collect()]


# Words with their readings.
SPOKEN = {
    "प्रयोग": "prayog", "क्रियापद": "kriyāpad", "म्हणतात": "mhaṇtāt", "बदलते": "badalte", "शब्द": "śabd", "वचन": "vacan", "कर्म": "karm", "भाषेत": "bhāṣet",
    "कर्ता": "kartā", "आणि": "āṇi", "करणारा": "karṇārā", "उदाहरणे": "udāharṇe", "मारले": "mārle", "खातो": "khāto", "रामाने": "rāmāne", "परस्पर": "paraspar",
    "आधारस्तंभ": "ādhārastambh", "विभक्तीत": "vibhaktīt", "ओलखण्याची": "olakhaṇyācī", "संबंधाला": "sambandhālā", "आंबा": "āmbā", "नपुंसकलिंगी": "napuṃsakliṅgī",
    "अंक": "aṅk", "தமிழ்": "tamiḻ", "ಕನ್ನಡ": "kannaḍa", "తెలుగు": "telugu", "മലയാളം": "malayāḷaṃ", "ਪੰਜਾਬੀ": "pañjābī", "ગુજરાતી": "gujarātī", "ਸਿੱਖ": "sikkh",
}
UNDROPPED = {"रामायणम्": "rāmāyaṇam", "भगवद्गीता": "bhagavadgītā", "नमस्ते": "namaste"}


def test_transliteration(spark):
    assert col(spark, lambda c: translit.to_latin(c, F.lit(True)), SPOKEN) == list(SPOKEN.values())
    assert col(spark, lambda c: translit.to_latin(c, F.lit(False)), UNDROPPED) == list(UNDROPPED.values())
    assert translit.transliterate('कर्ता, कर्म "प्रयोग"।') == 'kartā, karm "prayog".'
    assert translit.transliterate("१२३ abc") == "123 abc"
    # names and compounds need a lexicon: rules give these
    assert [translit.transliterate(w) for w in ("रावणास", "तृतीयपुरुषी")] == ["rāvṇās", "tṛtīypuruṣī"]
    assert col(spark, lambda c: translit.to_latin(c, F.lit(None).cast("boolean")), [None, ""]) == ["", ""]


def test_predicates(spark):
    assert col(spark, text.is_junk, [None, "", "  ", "...", "a", "a---", "ab---", "aaaa", "====a", "पढ़ें।"]) == [True, True, True, True, False, True, True, False, True, False]
    assert col(spark, text.has_indic_text, ["abc", "कa", "اردو", None]) == [False, True, True, False]
    assert col(spark, text.is_latin_only, ["", "abc é ₹", "क", None]) == [True, True, False, True]
    assert col(spark, text.dominant_script, ["ab कख", "क", "12", None, "abकखग"]) == ["latin", "devanagari", None, None, "devanagari"]
    assert col(spark, text.dominant_indic_script_name, ["abcd क", "abc", "தமிழ் क"]) == ["Devanagari", None, "Tamil"]
    assert col(spark, text.script_of, ["[", "é", "क", "1", "ٱ"]) == ["latin", "latin", "devanagari", None, "arabic"]
    assert col(spark, text.can_transliterate, ["क", "اردو", "a"]) == [True, False, False]
    assert col(spark, text.confidence_band, [84.5, 84.4, 69.5, 69.4, None], "double") == ["good", "neutral", "neutral", "warn", "warn"]
    rows = spark.createDataFrame([("abc", 39.0), ("abc", 40.0), ("कख", 12.0), ("कख", 11.0), ("abc", None)], "t string, c double")
    assert [r[0] for r in rows.select(text.is_noise("t", "c")).collect()] == [True, False, False, True, True]


def test_languages(spark):
    lists = [["hin", "xxx", "eng", "hin"], ["san", "eng"], [], None, ["urd"], ["eng"]]
    assert col(spark, text.known_languages, lists, "array<string>") == [["hin", "eng"], ["san", "eng"], ["eng"], ["eng"], ["urd"], ["eng"]]
    assert col(spark, text.source_iso, lists, "array<string>") == ["hi", "sa", "en", "en", "ur", "en"]
    assert col(spark, text.is_sanskrit_only, lists, "array<string>") == [False, True, False, False, False, False]
    assert col(spark, lambda c: text.with_language(c, "tam", True), lists[:2], "array<string>") == [["hin", "xxx", "eng", "tam"], ["san", "eng", "tam"]]
    assert col(spark, lambda c: text.with_language(c, "eng", False), [["eng", "hin"], None], "array<string>") == [["hin"], []]
    assert col(spark, text.language_name, ["hi", "xy"]) == ["Hindi", "XY"]


def test_formats(spark):
    assert col(spark, dates.format_bytes, [None, 0, 1023, 1024, 1536, 1048576, 5 * 1024**3, 5 * 1024**4], "long") == ["0 B", "0 B", "1023 B", "1.0 KB", "1.5 KB", "1.0 MB", "5.0 GB", "5120.0 GB"]
    at = lambda s: F.to_timestamp(F.lit(s))
    now = at("2026-03-05 10:00:00")
    got = one(spark, *(dates.format_date(at(s), now) for s in ("2026-03-05 09:05:00", "2026-03-04 23:00:00", "2026-01-02 00:00:00", "2025-12-31 00:00:00")))
    assert list(got) == ["9:05 AM", "Yesterday", "2 Jan", "31 Dec 2025"]
    assert one(spark, dates.default_title(now), dates.pdf_date(now))[:] == ("Scan 2026-03-05 10.00", "D:20260305100000+00'00'")
    assert col(spark, text.safe_name, [None, "  ", "a/b:c", "नमस्ते!", "x" * 70]) == ["scan", "scan", "abc", "नमस्ते", "x" * 60]
    assert col(spark, text.escape_html, ["<a href=\"x\">&'", None]) == ["&lt;a href=&quot;x&quot;&gt;&amp;&#39;", ""]
    assert col(spark, text.unescape_html, ["&amp;lt; &#39;"]) == ["< '"]
    assert col(spark, text.slug, ["/my app/v1/"]) == ["my-app-v1"]
    assert col(spark, text.pdf_text_string, ["aक😀"]) == ["<feff00610915d83dde00>"]
    assert col(spark, lambda c: text.highlight(c, "a.b"), ["xA.Bx aXb"]) == ["x<mark>A.B</mark>x aXb"]
    long = "x" * 50 + "  hit\n" + "y" * 80
    assert col(spark, lambda c: text.snippet(c, F.lit("hit")), [long, "hit"]) == ["…" + "x" * 38 + " hit " + "y" * 59 + "…", "hit…"]


def test_entities(spark):
    def kinds(s):
        return [(e["type"], e["value"], e["start"]) for e in entities.resolve(s)]

    assert kinds("raj@sbi.com") == [("email", "raj@sbi.com", 0)]
    assert kinds("pay raj@sbi now") == [("upi", "raj@sbi", 4)]
    assert kinds("27ABCDE1234F1Z5") == [("gstin", "27ABCDE1234F1Z5", 0)]
    assert kinds("99999123456") == [("phone", "9999123456", 1)]
    assert kinds("Rs. 1,000, due") == [("amount", "Rs. 1,000", 0)]
    assert kinds("12345678901234") == kinds("call 0987654321 0") == kinds(None) == kinds("") == []
    assert kinds("é123456") == [("pincode", "123456", 1)]
    assert kinds("2345 6789 0124")[0][0] == "aadhaar" and all(k != "aadhaar" for k, _, _ in kinds("2345 6789 0120"))
    assert col(spark, text.verhoeff_valid, ["234567890124", "234567890120", "12", None]) == [True, False, False, False]
    assert col(spark, lambda c: entities.values(c, "pincode"), ["é123456 1234567", None]) == [["123456"], []]
    rows = spark.createDataFrame([(1, "a@b.co x@y.in a@b.co")], "id int, t string").select("id", F.explode(entities.extract("t")).alias("e")).select("id", "e.*")
    got = [(r["ordinal"], r["value"], r["count"], r["href"]) for r in entities.group_entities(rows, "id").orderBy("ordinal").collect()]
    assert got == [(0, "a@b.co", 2, "mailto:a@b.co"), (1, "x@y.in", 1, "mailto:x@y.in")]
    assert entities.export_lines(entities.group_entities(rows, "id"), "id").first()["text"] == "Email: a@b.co\nEmail: x@y.in"


def test_payloads(spark):
    got = col(spark, payload.parse_code_value, ["upi://pay?pa=a@b&pn=Raj%20K&am=5", "//x.y", "WIFI:T:WPA;S:home;P:x;", "BEGIN:VCARD\nFN:Asha \nEND", "TEL:1", "mailto:a@b", "plain", "", None])
    assert [p["kind"] for p in got] == ["upi", "url", "wifi", "contact", "phone", "email", "text", "text", "text"]
    assert (got[0]["vpa"], got[0]["payee"], got[0]["amount"], got[0]["note"]) == ("a@b", "Raj K", "5", "")
    assert got[2]["ssid"] == "home" and got[3]["name"] == "Asha"


def test_chunks():
    assert [len(c) for c in chunks.chunk_text("x" * 1000)] == [451, 451, 98]
    page = "\n".join(f"ही ओळ क्रमांक {i} आहे आणि तिच्यात मजकूर आहे." for i in range(40))
    got = chunks.chunk_text(page)
    assert "".join("\n".join(got).split()) == "".join(page.split()) and max(map(len, got)) <= 450
    assert all(line in page.split("\n") for c in got for line in c.split("\n"))
    assert chunks.chunk_text("") == chunks.chunk_text(None) == chunks.chunk_text(" \n ") == []
    assert chunks.chunk_text("word " * 200)[0].endswith("word")
    long = ("x" * 200 + ". ") * 5
    assert len(chunks.chunk_text(long)[0]) == 403


def test_translate(spark):
    rows = spark.createDataFrame([(1, "a\nb", "mr"), (2, "same", "en"), (3, " ", "mr"), (4, "boom", "mr"), (5, None, "mr")], "id int, text string, source string")

    def fake(chunk, source, target):
        if chunk == "boom":
            raise RuntimeError("quota")
        return chunk.upper()

    got = {r.id: (r.translation, r.error) for r in chunks.translate(rows, fake, "en", consent=True).collect()}
    assert got == {1: ("A\nB", None), 2: ("same", None), 3: ("", None), 4: (None, "quota"), 5: ("", None)}
    memo = spark.createDataFrame([("own:mr>en:3:a\nb", "A B"), ("own:mr>en:3:a\nb", "A C")], "memo_key string, translation string")
    known, rest = chunks.with_memo(rows, memo, "own", "en")
    assert [(r.id, r.translation) for r in known.collect()] == [(1, "A B")] and sorted(r.id for r in rest.collect()) == [2, 3, 4, 5]
    import pytest

    for bad in ((None, "en", True), (fake, "en", False), (fake, "", True)):
        with pytest.raises(chunks.TranslationError):
            chunks.translate(rows, *bad)


def test_a_character_four_times_among_few_letters_is_noise(spark):
    rows = spark.createDataFrame([("rrrr***", 90.0), ("llll***", 90.0), ("rrr****", 90.0), ("rrrrr**", 90.0), ("abcd***", 90.0)], "t string, c double")
    assert [r[0] for r in rows.select(text.is_noise("t", "c")).collect()] == [True, True, True, False, False]
