from datetime import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from leafmill import schemas
from leafmill.operators import pdf, search, words
from leafmill.sources import store


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*(order or df.columns[:2])).collect()]


WORD = "page_id int, idx long, text string, confidence double, x0 double, y0 double, x1 double, y1 double"


def test_search(spark):
    docs = spark.createDataFrame([("a", "Tax form", 1), ("b", "Bill", 3), ("c", "Other", 2), ("d", "tax", 5)], "id string, title string, updatedAt int")
    pages = spark.createDataFrame([("a", 1, "no"), ("a", 0, "income TAX here"), ("b", 0, "tax"), ("b", 1, "a tax"), ("c", 0, None)], "docId string, index int, text string")
    got = [(r.id, r.score, r.snippet, r.matchPage) for r in search.search(docs, pages, " tAx ").collect()]
    assert got == [("a", 15, "income TAX here…", 0), ("d", 10, "", None), ("b", 10, "tax…", 0)]
    assert search.search(docs, pages, "  ").collect() == []


def test_merge(spark):
    indic = spark.createDataFrame(
        [(1, 0, "नमस्ते", 50.0, 0.0, 0.0, 100.0, 20.0), (1, 1, "lnvoice", 60.0, 0.0, 40.0, 100.0, 60.0), (1, 2, "sure", 99.0, 200.0, 40.0, 300.0, 60.0), (1, 3, "twin", 40.0, 0.0, 40.0, 100.0, 60.0)], WORD
    )
    latin = spark.createDataFrame(
        [(1, 0, "Namaste", 95.0, 0.0, 0.0, 100.0, 20.0), (1, 1, "Invoice", 55.0, 2.0, 40.0, 100.0, 60.0), (1, 2, "Sure", 80.0, 200.0, 40.0, 300.0, 60.0), (1, 3, "Extra", 70.0, 400.0, 40.0, 500.0, 60.0), (1, 4, "Weak", 59.0, 600.0, 40.0, 700.0, 60.0), (1, 5, "....", 90.0, 800.0, 40.0, 900.0, 60.0)],
        WORD,
    )
    got = [(r.text, r.source, r.noise) for r in words.merge_passes(indic, latin).orderBy("ordinal").collect()]
    # an Indic word uses no Latin one up; the best overlap goes to the first; a sure word stays
    assert got == [("नमस्ते", "indic", False), ("twin", "indic", False), ("Invoice", "latin", False), ("sure", "indic", False), ("Extra", "latin-recovered", False)]
    assert words.merge_passes(indic.limit(0), latin).where("source <> 'latin-recovered'").count() == 0
    assert words.merge_passes(indic, latin.limit(0)).count() == 4


def test_iou_matches_every_pair(spark):
    rng = np.random.default_rng(4)
    make = lambda n: [(int(p), i, "w", 50.0, *(float(v) for v in (x, y, x + w, y + h))) for i, (p, x, y, w, h) in enumerate(zip(rng.integers(0, 3, n), rng.uniform(-50, 200, n), rng.uniform(0, 200, n), rng.uniform(5, 90, n), rng.uniform(5, 90, n)))]
    a, b = make(60), make(60)

    def iou(p, q):
        w, h = min(p[6], q[6]) - max(p[4], q[4]), min(p[7], q[7]) - max(p[5], q[5])
        return 0 if w <= 0 or h <= 0 else w * h / ((p[6] - p[4]) * (p[7] - p[5]) + (q[6] - q[4]) * (q[7] - q[5]) - w * h)

    want = sorted((p[0], p[1], q[1]) for p in a for q in b if p[0] == q[0] and iou(p, q) > 0.2)
    found = words.iou_candidates(spark.createDataFrame(a, WORD), spark.createDataFrame(b, WORD), 0.2)
    assert sorted(tuple(r) for r in found.select("page_id", "a_idx", "b_idx").collect()) == want and want


def test_lines_and_confidence(spark):
    own = spark.createDataFrame(
        [(1, 0, "a", 90.0, 0.0, 0.0, 1.0, 10.0), (1, 1, "b", None, 0.0, 4.0, 1.0, 14.0), (1, 2, " ", 1.0, 0.0, 40.0, 1.0, 50.0), (1, 3, "c", 60.0, 0.0, 30.0, 1.0, 40.0)], WORD
    )
    assert [r.line_text for r in words.lines(own, "idx").orderBy("line").collect()] == ["a b", "c"]
    assert words.page_text(own, "idx").first().text == "a b\nc"
    assert tuple(words.page_confidence(own).first()) == (1, (90 + 0 + 1 + 60) / 4, 4, 3)
    pages = spark.createDataFrame([(1, 80.0), (1, None), (1, 0.0), (2, None)], "docId int, confidence double")
    assert rows(words.document_confidence(pages)) == [(1, 80.0, 80 / 3), (2, 0.0, 0.0)]


def test_store_changes(spark, tmp_path):
    docs = spark.createDataFrame([("a", "A", 1), ("b", "B", 2)], "id string, title string, updatedAt int")
    pages = spark.createDataFrame([("p0", "a", 0), ("p1", "a", 1), ("p2", "a", 2), ("q0", "b", 0)], "id string, docId string, index int")
    ids = lambda *v: spark.createDataFrame([(x,) for x in v], "id string")
    assert rows(store.delete_pages(pages, ids("p1")), "docId", "index") == [("p0", "a", 0), ("p2", "a", 1), ("q0", "b", 0)]
    left = store.delete_documents(docs, pages, ids("a", "zzz"))
    assert [rows(x) for x in left] == [[("b", "B", 2)], [("q0", "b", 0)]] or [len(rows(x)) for x in left] == [1, 1]
    order = spark.createDataFrame([("a", ["p2", "nope", "p0"])], "docId string, ids array<string>")
    assert dict((r.id, r["index"]) for r in store.reorder_pages(pages, order).collect()) == {"p0": 2, "p1": 1, "p2": 0, "q0": 0}
    more = spark.createDataFrame([("n0", "b", 0), ("n1", "b", 1), ("n2", "c", 0)], "id string, docId string, index int")
    assert {r.id: r["index"] for r in store.add_pages(pages, more).collect()} == {"p0": 0, "p1": 1, "p2": 2, "q0": 0, "n0": 1, "n1": 2, "n2": 0}
    patch = spark.createDataFrame([("a", "new", None), ("x", "no", 1)], "id string, title string, updatedAt int")
    assert rows(store.update(docs, patch)) == [("a", "new", 1), ("b", "B", 2)]
    settings = store.overlay_settings(spark.createDataFrame([("autoOcr", None), ("own", "1")], schemas.SETTINGS), store.default_settings(spark))
    got = {r.key: r.value for r in settings.collect()}
    assert got["autoOcr"] is None and got["own"] == "1" and got["jpegQuality"] == "0.86" and len(got) == 16
    changed = store.set_settings(spark.createDataFrame([("k", "old")], schemas.SETTINGS), spark.createDataFrame([("k", "1", 1), ("k", "2", 2), ("n", "3", 1)], "key string, value string, version int"))
    assert {r.key: r.value for r in changed.collect()} == {"k": "2", "n": "3"}


def test_store_files(spark, tmp_path):
    s = store.Store(spark, f"file://{tmp_path}/it")
    assert [p for _, p in s.problems()] == ["missing"] * 3
    s.repair()
    assert s.problems() == [] and s.read("documents").count() == 0
    made = store.create_document(s.read("documents"), "d1", datetime(2026, 1, 2, 3, 4))
    s.write("documents", made)
    assert s.read("documents").first().title == "Scan 2026-01-02 03.04"
    found = {"documents": schemas.DOCUMENTS, "pages": schemas.SETTINGS}
    assert ("settings", "missing") in store.schema_problems(found) and ("pages", "missing column id") in store.schema_problems(found)
    assert ("pages", "wrong key other") in store.schema_problems(found, {"pages": "other"})


def test_pdf(spark):
    own = spark.createDataFrame([(1, 0, "नम a", 90.0, 10.0, 10.0, 60.0, 30.0), (1, 1, "tiny", 90.0, 0.0, 0.0, 0.5, 0.5)], WORD)
    pages = spark.createDataFrame([(7, 0, 1, "T", 4, 2, bytes(range(32)))], "doc_id int, index int, page_id int, title string, width int, height int, data binary")
    made = bytes(pdf.searchable(pages, own).first().pdf)
    assert made.startswith(b"%PDF-1.7") and made.rstrip().endswith(b"%%EOF") and b"3 Tr" in made or b"FlateDecode" in made
    start = int(made.rsplit(b"startxref\n", 1)[1].split(b"\n")[0])
    assert made[start : start + 4] == b"xref"
    for n, line in enumerate(made[start:].split(b"\n")[3:8], 1):
        assert made[int(line[:10]) :].startswith(f"{n} 0 obj".encode())
    assert [tuple(r) for r in pdf.cid_inventory(spark.createDataFrame([(1, "aba"), (2, None)], "d int, t string"), "d", "t").orderBy("cid").collect()] == [(1, "a", 1), (1, "b", 2)]


@pytest.mark.parametrize("angle", [0, 90])
def test_geometry(spark, angle):
    from leafmill.functions import geometry as g

    points = [(0.0, 0.0), (10.0, 0.0), (10.0, 5.0), (0.0, 5.0)]
    mixed = [points[i] for i in ((2, 0, 3, 1) if angle else (0, 1, 2, 3))]
    q = F.array(*(F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x, y in mixed))
    r = spark.range(1).select(q.alias("q")).select(g.order_corners(F.col("q")).alias("q")).select(
        "q", g.polygon_area(F.col("q")).alias("area"), g.is_convex(F.col("q")).alias("convex"), g.min_interior_angle(F.col("q")).alias("angle"), g.estimate_output_size(g.scale_quad(F.col("q"), 1000.0)).alias("size"),
        g.line_intersection(F.lit(3.0), F.lit(0.0), F.lit(4.0), F.lit(np.pi / 2)).alias("meet"), g.line_intersection(F.lit(3.0), F.lit(1.0), F.lit(4.0), F.lit(1.0)).alias("none"),
        g.page_layout(F.lit(2000), F.lit(1000), "a4").alias("page"), g.inset_corners(F.lit(100.0), F.lit(50.0)).alias("inset"),
    ).first()
    assert [(p.x, p.y) for p in r.q] == points and (r.area, r.convex) == (50.0, True) and abs(r.angle - 90) < 1e-9
    assert (r["size"].width, r["size"].height) == (2400, 1200) and abs(r.meet.x - 3) < 1e-9 and abs(r.meet.y - 4) < 1e-9 and r.none is None
    assert r.page.pageWidth == 841.89 and abs(r.page.drawWidth - 841.89) < 1e-9 and (r.inset[2].x, r.inset[2].y) == (96.0, 48.0)


def test_events_without_value_reset_the_count(spark, tmp_path):
    from leafmill.plans.queries import QUERIES

    rows = [(1, i, "view", v) for i, v in enumerate((5.0, 5.0, None, 5.0, 5.0))]
    events = spark.createDataFrame(rows, "user_id long, event_id long, event_type string, value double")
    events.selectExpr("*", "timestamp_seconds(event_id) AS ts").write.parquet(str(tmp_path / "events.parquet"))
    got = {r.frame_id: r["count"] for r in QUERIES["arm_events"](spark, str(tmp_path)).collect()}
    assert got == {0: 1, 1: 2, 2: 0, 3: 1, 4: 2}


def plainly_merged(a, b):
    """The passes of one page merged word by word."""

    def iou(p, q):
        w, h = min(p[6], q[6]) - max(p[4], q[4]), min(p[7], q[7]) - max(p[5], q[5])
        return 0 if w <= 0 or h <= 0 else w * h / ((p[6] - p[4]) * (p[7] - p[5]) + (q[6] - q[4]) * (q[7] - q[5]) - w * h)

    indic, latin = (lambda s: any("ऀ" <= c <= "ॿ" for c in s)), (lambda s: all(c <= "ɏ" for c in s))
    used, out = set(), []
    for n, p in enumerate(a):
        best = max((q for q in b if q[1] not in used and iou(p, q) > 0.35), key=lambda q: (iou(p, q), -q[1]), default=None)
        if best is not None and not indic(p[2]):
            used.add(best[1])
            if latin(best[2]) and (best[3] or 0) + 8 >= (p[3] or 0):
                out.append((0, n, best, "latin"))
                continue
        out.append((0, n, p, "indic"))
    out += [(1, q[1], q, "latin-recovered") for q in b if latin(q[2]) and (q[3] or 0) >= 60 and any(map(str.isalnum, q[2])) and not any(iou(p, q) > 0.35 for p in a)]
    middle = lambda x: (x[2][5] + x[2][7]) / 2
    line, lines, last = 0, [], None
    for x in sorted(out, key=lambda x: (middle(x), x[2][4], x[2][2], *x[:2])):
        line += last is not None and abs(middle(x) - last) > max(6, (x[2][7] - x[2][5]) * 0.55)
        last = middle(x)
        lines.append((line, x[2][4], x[2][2], *x[:2], x))
    noise = lambda w: not any(map(str.isalnum, w[2])) or (w[3] or 0) < (12 if indic(w[2]) else 40)
    return [(x[2][2], x[2][3], *x[2][4:], x[3], noise(x[2])) for *_, x in sorted(lines, key=lambda x: x[:5])]


def test_merge_matches_a_plain_one(spark, monkeypatch):
    from leafmill.operators import passes

    monkeypatch.setattr(passes, "_ROWS", 50)
    monkeypatch.setattr(passes, "_PAIRS", 7)
    rng = np.random.default_rng(7)
    some = ["abc", "नम", "naïve", "...", "x", "नमx"]

    def make(page, n, shift):
        # coarse places, so that boxes, overlaps and edges tie; one box covers much of the page
        box = [(float(x), float(y), float(x + w), float(y + h)) for x, y, w, h in zip(rng.integers(0, 12, n) * 10 + shift, rng.integers(0, 8, n) * 6, rng.integers(2, 5, n) * 5, rng.integers(1, 4, n) * 6)]
        box[0] = (0.0, -10.0, 500.0, 300.0)
        return [(page, k, str(rng.choice(some)), None if rng.random() < 0.1 else float(rng.integers(0, 20) * 5), *q) for k, q in enumerate(box)]

    a, b = {p: make(p, n, 0) for p, n in enumerate((3, 40, 90, 1))}, {p: make(p, n, p % 2) for p, n in enumerate((30, 60, 80, 5))}
    df = lambda x: spark.createDataFrame([r for v in x.values() for r in v], WORD)
    got = {p: [] for p in a}
    for r in words.merge_passes(df(a), df(b)).orderBy("page_id", "ordinal").collect():
        assert r.ordinal == len(got[r.page_id])
        got[r.page_id].append(tuple(r)[2:])
    assert got == {p: plainly_merged(a[p], b[p]) for p in a}


def test_passes_of_a_page_meet_without_a_shuffle(spark, tmp_path):
    from leafmill.plans.queries import QUERIES

    docs = lambda ids: spark.createDataFrame([(i, "one two three") for i in ids], "doc_id long, text string")
    docs([1, 2, None]).write.parquet(str(tmp_path / "apart/documents.parquet"))
    docs([1, 2, 1]).write.parquet(str(tmp_path / "repeated/documents.parquet"))
    for name in ("iou_candidates", "merged_passes"):
        plan = QUERIES[name](spark, str(tmp_path / "apart"))._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and "Join" not in plan, name
    pairs = {k: QUERIES["iou_candidates"](spark, str(tmp_path / k)).groupBy("page_id").count().collect() for k in ("apart", "repeated")}
    pairs = {k: dict(map(tuple, v)) for k, v in pairs.items()}
    # a page without an id overlaps with nothing; documents of one id are one page
    assert set(pairs["apart"]) == {1, 2} and pairs["repeated"] == {1: 4 * pairs["apart"][1], 2: pairs["apart"][2]}
    assert QUERIES["merged_passes"](spark, str(tmp_path / "apart")).where("page_id is null and source = 'indic'").count() == 3
