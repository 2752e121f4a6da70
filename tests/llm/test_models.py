import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from leafmill.llm import ann, toxicity
from tests.llm.conftest import CLEAN


def test_grammar():
    run = lambda s: list(toxicity.grammar().run(s))
    assert run("I") == ["I"] and run("NI") == ["N", "I~"] and run("N...I")[-1] == "I~" and run("N....I")[-1] == "I"
    assert run("N.....I")[-1] == "I" and run("RI") == ["R", "I^"] and run("R" + "." * 20 + "H")[-1] == "H^"
    assert run("TI")[-1] == "I@" and run("T.NI")[-1] == "I~@" and run("RTNI")[-1] == "I~^@"
    assert set(run("INRTH.")) <= {*".TNR", *toxicity.KINDS}


def test_clauses_decide():
    model = toxicity.Model(toxicity._stated(), {}, (-1.0, *(2.0 if "~" not in k and "^" not in k else 0.0 for k in toxicity.KINDS), 0.0, 0.0))
    score = toxicity.Scorer(model).score
    plain, negated, reported, none = (score(t) for t in ("you are an idiot", "you are not an idiot", "he said idiot", "you are kind"))
    assert plain > 0.5 > negated and reported < 0.5 and none < 0.5 and score("") == none
    # what is negated in one clause isn't in the next
    assert score("not at all. you idiot") > 0.5


def corpus(n, seed):
    rng = random.Random(seed)
    words = ["".join(rng.choices("abcdefgh", k=rng.randint(2, 8))) for _ in range(400)]
    rows = []
    for i in range(n):
        own = [rng.choice(words) for _ in range(rng.randint(20, 120))]
        toxic = i % 6 == 0
        if toxic:
            for _ in range(4):
                own[rng.randrange(len(own))] = rng.choice(["scumbag", "dimwit", "zorp" + "".join(rng.choices("xyz", k=4)), "jerk"])
        rows.append((i, " ".join(own), int(toxic)))
    return rows


def test_learning(spark):
    rows = corpus(900, 1)
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1, y) for i, _, y in rows] + [(None, 1, 1), (3, 0, None)], "doc_id long, quality int, toxic int")
    model = toxicity.fit(docs, labels)
    assert b"scumbag" in model.words and any(w.startswith(b"zorp") for w in model.stems) and not any(c == "I" and w < b"i" and len(w) < 3 for w, (c, _) in model.words.items())
    got = {r.doc_id: r for r in toxicity.score(docs, model).collect()}
    held = [(got[i], y) for i, _, y in rows if zlib.crc32(str(i).encode()) % 5 == 0]
    assert all(r.held_out for r, _ in held) and sum(r.held_out for r in got.values()) == len(held)
    assert np.mean([r.predicted == y for r, y in held]) > 0.97 and all((r.score >= 0.5) == bool(r.predicted) for r in got.values())
    # labels of held-out rows change nothing
    flipped = labels.withColumn("toxic", F.when(toxicity.held_out(), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    assert toxicity.fit(docs, flipped) == model
    kept = {r.doc_id for r in toxicity.reject(docs, model).collect()}
    assert kept == {i for i, r in got.items() if not r.predicted}


def test_toxicity_edges(spark, edge):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    model = toxicity.fit(edge, labels)
    out = toxicity.score(edge, model)
    assert out.count() == edge.count() and out.where("score is null or score < 0 or score > 1").count() == 0
    assert out.where("doc_id is null and not held_out").count() == 0
    assert toxicity.score(edge.limit(0), model).count() == 0 and toxicity.reject(edge, model).columns == edge.columns
    assert toxicity.learn([("only clean", 0)]) == toxicity.learn([])


def brute(rows, every=20, k=20):
    good = [(i, np.array(v, float)) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    out = {}
    for q, x in good:
        if q % every == 0:
            scored = sorted((-float(np.cumsum(x * y)[-1]), i) for i, y in good if i != q)[:k]
            out[q] = [(i, -s) for s, i in scored]
    return out


VEC = "vec_id long, embedding array<float>, rank int, cell int"


def found(spark, rows, **more):
    df = spark.createDataFrame([(i, v, 1, 1) for i, v in rows], VEC)
    out = {}
    for r in ann.nearest(df, **more).orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r["rank"] == len(out[r.query_id])
    return out


def vectors(n, width=16, seed=1):
    return [(i, [float(np.float32(x)) for x in v]) for i, v in enumerate(np.random.default_rng(seed).normal(size=(n, width)))]


@pytest.mark.parametrize(("cell", "queries"), [(8192, 16384), (150, 10)])
def test_recall_and_scores(spark, monkeypatch, cell, queries):
    monkeypatch.setattr(ann, "VECTORS_IN_CELL", cell)
    monkeypatch.setattr(ann, "QUERIES_IN_TASK", queries)
    monkeypatch.setattr(ann, "LEAF", 32)
    rows = vectors(900)
    rows = [(i, [float(np.float32(x * (1 + i % 3))) for x in v]) for i, v in rows]
    want, got = brute(rows), found(spark, rows)
    assert got.keys() == want.keys()
    hits = sum(len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in want)
    assert hits >= 0.93 * sum(map(len, want.values()))
    table = dict(rows)
    for q, found_ in got.items():
        assert found_ == sorted(found_, key=lambda x: (-x[1], x[0])) and q not in {i for i, _ in found_}
        for i, s in found_:
            assert s == float(np.cumsum(np.array(table[q]) * np.array(table[i]))[-1])


def test_exact_without_early_stop(spark, monkeypatch):
    monkeypatch.setattr(ann, "VECTORS_IN_CELL", 60)
    rows = vectors(400, 8, 2)
    assert found(spark, rows, stop=1 - 1e-12) == brute(rows)


def test_copies_ties_and_bad_rows(spark):
    same = [1.0, 2.0, 0.0]
    rows = [(i, same) for i in range(0, 300)] + [(1000 + i, [0.5, float(i), 1.0]) for i in range(5)]
    bad = [(None, same), (2000, None), (2020, []), (2040, [0.0, 0.0, 0.0]), (2060, [1.0, None, 2.0]), (2080, [1.0, float("nan"), 2.0]), (2100, [float("inf"), 1.0, 1.0]), (2120, [1.0, 1.0])]
    got = found(spark, rows + bad + rows[:3])
    assert got == brute(rows) and 0 in got and 2000 not in got
    few = [(20, [1.0, 0.0]), (21, [0.5, 0.5]), (40, [-1.0, 0.0])]
    assert found(spark, few) == brute(few)
    assert found(spark, []) == {} and found(spark, bad[1:5]) == {} and found(spark, [(20, [1.0])]) == {}


def test_chi_square():
    x = np.random.default_rng(1).chisquare(ann.DIMENSIONS, 200_000)
    for q in (2.0, 7.344, 15.5):
        assert abs((x < q).mean() - float(ann.chi_square_cdf(q))) < 0.005
    assert abs(float(ann.chi_square_cdf(ann.stopping_ratio(0.9))) - 0.9) < 1e-9


def test_clean_text_is_left_alone(spark):
    model = toxicity.learn([(t, y) for _, t, y in corpus(600, 2)])
    assert toxicity.Scorer(model).score(CLEAN) < 0.5


def plain_score(text, model):
    """The score from the definition: each match looks back in its clause for what marks it; no machine, no classes of the operator."""
    total, clauses, count = {}, 0, 0
    for clause in text.lower().replace("?", ".").replace("\n", ".").split("."):
        own = clause.replace(",", " ").split()
        count += len(own)
        found = []
        for w in own:
            stems = [model.stems[w[:n].encode()] for n in range(4, 7) if len(w) >= n and w[:n].encode() in model.stems]
            found.append(model.words.get(w.encode()) or max(stems, key=lambda x: x[1], default=(".", 0.0)))
        best = {}
        for i, (c, weight) in enumerate(found):
            if c in "IH":
                before = [x for x, _ in found[:i]]
                kind = c + "~" * ("N" in before[-4:]) + "^" * ("R" in before) + "@" * ("T" in before[-4:])
                best[kind] = max(weight, best.get(kind, 0.0))
        for kind, weight in best.items():
            total[kind] = total.get(kind, 0.0) + weight
        clauses += bool(best)
    z = model.coefficients[0] + (model.coefficients[-2] if clauses else 0.0) + model.coefficients[-1] * np.log1p(100 * clauses / max(1, count))
    kinds = [c + a + b + d for c in "IH" for a in ("", "~") for b in ("", "^") for d in ("", "@")]
    z += sum(model.coefficients[1 + kinds.index(k)] * np.log1p(v) for k, v in total.items())
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def test_scores_against_a_plain_recomputation():
    rng = random.Random(5)
    words = toxicity._stated() | {b"zorp": ("I", 3.25), b"jerk": ("I", 0.5)}
    model = toxicity.Model(words, {b"dimw": ("I", 1.5), b"dimwit": ("I", 2.5), b"smash": ("H", 1.0)}, tuple(rng.uniform(-0.6, 0.6) for _ in range(len(toxicity.KINDS) + 3)))
    known = "idiot zorp jerk dimwits dimwxy smashing kill you they not never said wrote tree house river".split()
    scorer, seen = toxicity.Scorer(model), set()
    for n in range(4000):
        text = "".join(rng.choice(known) + rng.choice([" "] * 7 + [", ", ". ", "? ", "\n"]) for _ in range(n % 40))
        text = text.upper() if n % 7 == 0 else text
        want = plain_score(text, model)
        assert abs(scorer.score(text) - want) < 1e-9, text
        seen.add(round(float(want), 6))
    assert len(seen) > 2000
