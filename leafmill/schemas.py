"""The relations of a scanned-document collection and its two static dimensions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

POINT = T.StructType([T.StructField("x", T.DoubleType()), T.StructField("y", T.DoubleType())])
BOX = T.StructType([T.StructField(c, T.DoubleType()) for c in ("x0", "y0", "x1", "y1")])
WORD = T.StructType([T.StructField("text", T.StringType()), T.StructField("confidence", T.DoubleType()), T.StructField("bbox", BOX), T.StructField("source", T.StringType()), T.StructField("noise", T.BooleanType())])
ENTITY = T.StructType(
    [T.StructField("type", T.StringType()), T.StructField("label", T.StringType()), T.StructField("value", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("sensitive", T.BooleanType()), T.StructField("href", T.StringType())]
)
IMAGE = T.StructType([T.StructField(c, T.IntegerType()) for c in ("width", "height", "nChannels", "mode")] + [T.StructField("data", T.BinaryType())])

DOCUMENTS = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("title", T.StringType()),
        T.StructField("createdAt", T.TimestampType()),
        T.StructField("updatedAt", T.TimestampType()),
        T.StructField("pageCount", T.IntegerType()),
        T.StructField("tags", T.ArrayType(T.StringType())),
        T.StructField("langs", T.ArrayType(T.StringType())),
    ]
)
PAGES = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("docId", T.StringType()),
        T.StructField("index", T.IntegerType()),
        T.StructField("createdAt", T.TimestampType()),
        T.StructField("blob", T.BinaryType()),
        T.StructField("ocrBlob", T.BinaryType()),
        T.StructField("thumb", T.BinaryType()),
        T.StructField("width", T.IntegerType()),
        T.StructField("height", T.IntegerType()),
        T.StructField("filter", T.StringType()),
        T.StructField("words", T.ArrayType(WORD)),
        T.StructField("text", T.StringType()),
        T.StructField("confidence", T.DoubleType()),
        T.StructField("ocrLangs", T.ArrayType(T.StringType())),
    ]
)
SETTINGS = T.StructType([T.StructField("key", T.StringType()), T.StructField("value", T.StringType())])
STORES = {"documents": (DOCUMENTS, "id"), "pages": (PAGES, "id"), "settings": (SETTINGS, "key")}

# Scripts with their inclusive code-point ranges, in the order in which a character is looked up.
SCRIPTS = (
    ("latin", "Latin", ((0x0041, 0x024F),)),
    ("devanagari", "Devanagari", ((0x0900, 0x097F), (0xA8E0, 0xA8FF))),
    ("bengali", "Bengali", ((0x0980, 0x09FF),)),
    ("gurmukhi", "Gurmukhi", ((0x0A00, 0x0A7F),)),
    ("gujarati", "Gujarati", ((0x0A80, 0x0AFF),)),
    ("odia", "Odia", ((0x0B00, 0x0B7F),)),
    ("tamil", "Tamil", ((0x0B80, 0x0BFF),)),
    ("telugu", "Telugu", ((0x0C00, 0x0C7F),)),
    ("kannada", "Kannada", ((0x0C80, 0x0CFF),)),
    ("malayalam", "Malayalam", ((0x0D00, 0x0D7F),)),
    ("arabic", "Perso-Arabic", ((0x0600, 0x06FF), (0x0750, 0x077F), (0xFB50, 0xFDFF), (0xFE70, 0xFEFF))),
)

# Languages as (code, ISO code, name, script, size in MB).
LANGUAGES = (
    ("eng", "en", "English", "latin", 4.0),
    ("hin", "hi", "Hindi", "devanagari", 1.1),
    ("ben", "bn", "Bengali", "bengali", 0.8),
    ("tam", "ta", "Tamil", "tamil", 3.1),
    ("tel", "te", "Telugu", "telugu", 2.7),
    ("mar", "mr", "Marathi", "devanagari", 2.1),
    ("guj", "gu", "Gujarati", "gujarati", 1.4),
    ("kan", "kn", "Kannada", "kannada", 3.5),
    ("mal", "ml", "Malayalam", "malayalam", 5.1),
    ("pan", "pa", "Punjabi", "gurmukhi", 0.5),
    ("ori", "or", "Odia", "odia", 1.5),
    ("asm", "as", "Assamese", "bengali", 2.0),
    ("urd", "ur", "Urdu", "arabic", 1.4),
    ("san", "sa", "Sanskrit", "devanagari", 12.0),
    ("nep", "ne", "Nepali", "devanagari", 1.0),
)


def languages(spark: SparkSession) -> DataFrame:
    """15 rows."""
    return spark.createDataFrame([tuple(x) for x in LANGUAGES], "code string, iso string, name string, script string, size double")


def scripts(spark: SparkSession) -> DataFrame:
    """One row for each range of each script."""
    return spark.createDataFrame([(k, n, a, b) for k, n, rs in SCRIPTS for a, b in rs], "script string, name string, low int, high int")
