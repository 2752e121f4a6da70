"""Searchable PDF files: the relations of their text layer, and their bytes."""

from __future__ import annotations

import zlib

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafmill.functions.geometry import text_placement
from leafmill.functions.text import grapheme_clusters, js_trim

_HEAD = b"%PDF-1.7\n%\xe2\xe3\xcf\xd3\n"


def cid_inventory(rows: DataFrame, key: str, text: str) -> DataFrame:
    """``(key, cluster, cid)``: a document's distinct grapheme clusters, numbered from 1 by first appearance.

    Clusters are narrowed to their first places before they are numbered, so
    what is sorted is a document's alphabet and not its text.
    """
    each = rows.select(F.col(key), F.posexplode(grapheme_clusters(text)).alias("pos", "cluster"))
    first = each.groupBy(key, "cluster").agg(F.min("pos").alias("pos"))
    return first.select(key, "cluster", F.row_number().over(Window.partitionBy(key).orderBy("pos")).alias("cid"))


def text_layer(words: DataFrame, height: Column, dpi: float = 200.0) -> DataFrame:
    """``(page_id, idx, text, x, baseline, fontSize, stretch)`` of the words that show, for pages at ``dpi``."""
    scale = F.lit(72.0 / dpi)
    shown = words if "noise" not in words.columns else words.where(~F.coalesce("noise", F.lit(False)))
    own = shown.withColumn("text", js_trim("text")).where(F.col("text") != "")
    box = F.struct("x0", "y0", "x1", "y1")
    placed = own.withColumn("p", text_placement(box, F.size(grapheme_clusters("text")), scale, scale, height * scale, F.lit(0.0), F.lit(0.0)))
    return placed.where("p is not null").select("page_id", "idx", "text", "p.*")


def _stream(entries: str, data: bytes) -> bytes:
    """Deflated only if that makes it smaller."""
    small = zlib.compress(data, 9)
    packed = len(small) < len(data)
    data = small if packed else data
    return f"<< {entries} /Length {len(data)}{' /Filter /FlateDecode' if packed else ''} >>\nstream\n".encode("latin-1") + data + b"\nendstream"


def _to_unicode(clusters: list[str]) -> bytes:
    """The table from numbers to texts, in blocks of at most 100 lines."""
    lines = [f"<{cid:04x}> <{c.encode('utf-16-be').hex()}>" for cid, c in enumerate(clusters, 1)]
    blocks = [lines[i : i + 100] for i in range(0, len(lines), 100)]
    body = "\n".join(f"{len(b)} beginbfchar\n" + "\n".join(b) + "\nendbfchar" for b in blocks)
    return f"/CIDInit /ProcSet findresource begin\n12 dict begin\nbegincmap\n/CMapName /Text def\n/CMapType 2 def\n1 begincodespacerange\n<0000> <ffff>\nendcodespacerange\n{body}\nendcmap\nend\nend".encode("latin-1")


def build(pages: list[dict], title: str = "Scan") -> bytes:
    """A file with a page for each of ``{width, height, jpeg or rgb, words}``; a word is ``{cids, x, baseline, fontSize, stretch}``.

    ``clusters`` of the first page lists the texts of all numbers. Text is
    invisible, above the picture, and stretched to its measured width.
    """
    clusters = pages[0]["clusters"] if pages else []
    objects: list[bytes] = [b"", b""]

    def add(body: bytes) -> int:
        objects.append(body)
        return len(objects)

    unicode = add(_stream("", _to_unicode(clusters)))
    descriptor = add(b"<< /Type /FontDescriptor /FontName /Blank /Flags 4 /FontBBox [0 0 500 1000] /ItalicAngle 0 /Ascent 900 /Descent -100 /CapHeight 900 /StemV 0 >>")
    child = add(f"<< /Type /Font /Subtype /CIDFontType2 /BaseFont /Blank /CIDSystemInfo << /Registry (Adobe) /Ordering (Identity) /Supplement 0 >> /FontDescriptor {descriptor} 0 R /DW 500 >>".encode())
    font = add(f"<< /Type /Font /Subtype /Type0 /BaseFont /Blank /Encoding /Identity-H /DescendantFonts [{child} 0 R] /ToUnicode {unicode} 0 R >>".encode())
    kids = []
    for p in pages:
        w, h = p["pageWidth"], p["pageHeight"]
        size = f"/Type /XObject /Subtype /Image /Width {p['width']} /Height {p['height']} /ColorSpace /DeviceRGB /BitsPerComponent 8"
        if p.get("jpeg") is not None:
            jpeg = bytes(p["jpeg"])
            image = add(f"<< {size} /Filter /DCTDecode /Length {len(jpeg)} >>\nstream\n".encode() + jpeg + b"\nendstream")
        else:
            image = add(_stream(size, bytes(p["rgb"])))
        ops = [f"q {w:.2f} 0 0 {h:.2f} 0 0 cm /Im Do Q", "BT", "3 Tr"]
        for t in p["words"]:
            ops += [f"{t['stretch']:.2f} Tz", f"/F1 {t['fontSize']:.2f} Tf", f"1 0 0 1 {t['x']:.2f} {t['baseline']:.2f} Tm", "<" + "".join(f"{c:04x}" for c in t["cids"]) + "> Tj"]
        content = add(_stream("", "\n".join([*ops, "ET"]).encode("latin-1")))
        kids.append(add(f"<< /Type /Page /Parent 2 0 R /MediaBox [0 0 {w:.2f} {h:.2f}] /Contents {content} 0 R /Resources << /XObject << /Im {image} 0 R >> /Font << /F1 {font} 0 R >> >> >>".encode()))
    objects[0] = b"<< /Type /Catalog /Pages 2 0 R >>"
    objects[1] = f"<< /Type /Pages /Count {len(kids)} /Kids [{' '.join(f'{k} 0 R' for k in kids)}] >>".encode()
    info = add(b"<< /Title <feff" + title.encode("utf-16-be").hex().encode() + b"> /Creator (leafmill) >>")
    out, places = bytearray(_HEAD), []
    for n, body in enumerate(objects, 1):
        places.append(len(out))
        out += f"{n} 0 obj\n".encode() + body + b"\nendobj\n"
    start = len(out)
    out += f"xref\n0 {len(objects) + 1}\n0000000000 65535 f \n".encode() + b"".join(f"{p:010d} 00000 n \n".encode() for p in places)
    out += f"trailer\n<< /Size {len(objects) + 1} /Root 1 0 R /Info {info} 0 R >>\nstartxref\n{start}\n%%EOF\n".encode()
    return bytes(out)


def searchable(pages: DataFrame, words: DataFrame, dpi: float = 200.0) -> DataFrame:
    """``pages(doc_id, index, page_id, title, width, height, data)`` of RGBA pictures and their words -> ``(doc_id, pdf binary)``.

    A document is one value, so its pages meet in one task, without the words
    that don't show.
    """
    scale = 72.0 / dpi
    layer = text_layer(words.join(pages.select("page_id", F.col("height").alias("_h")), "page_id"), F.col("_h"), dpi)
    own = layer.groupBy("page_id").agg(F.sort_array(F.collect_list(F.struct("idx", "text", "x", "baseline", "fontSize", "stretch", grapheme_clusters("text").alias("clusters")))).alias("words"))
    joined = pages.join(own, "page_id", "left").select("doc_id", "index", "title", "width", "height", "data", "words")

    def make(x: pd.DataFrame) -> pd.DataFrame:
        x = x.sort_values("index")
        number: dict[str, int] = {}
        built = []
        for p in x.itertuples(index=False):
            placed = [dict(t) for t in (p.words if p.words is not None else ())]
            for t in placed:
                t["cids"] = [number.setdefault(c, len(number) + 1) for c in t["clusters"]]
            rgba = bytes(p.data)
            rgb = bytearray(len(rgba) // 4 * 3)
            for c in range(3):
                rgb[c::3] = rgba[c::4]
            built.append({"width": int(p.width), "height": int(p.height), "pageWidth": p.width * scale, "pageHeight": p.height * scale, "rgb": bytes(rgb), "words": placed})
        if built:
            built[0]["clusters"] = list(number)
        return pd.DataFrame({"doc_id": [x["doc_id"].iloc[0]], "pdf": [build(built, x["title"].iloc[0] or "Scan")]})

    kind = pages.schema["doc_id"].dataType.simpleString()
    return joined.groupBy("doc_id").applyInPandas(make, f"doc_id {kind}, pdf binary")
