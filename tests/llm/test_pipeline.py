import random

import corpus_pipeline
import __spark_entry__ as entry
from leafmill.llm import linededup, secrets, simhash, toxicity
from leafmill.llm.queries import QUERIES
from tests.llm.conftest import SECRET

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
INSULT = "you worthless idiot, you stupid moron and pathetic loser. what disgusting scum"


def made(spark, path):
    rng = random.Random(5)
    line = lambda: " ".join("".join(rng.choices("abcdefghijklm", k=rng.randint(2, 8))) for _ in range(rng.randint(6, 25)))
    rows = [(i, f"{line()}\n{line()}\n{line()}") for i in range(60)]
    rows += [(100, rows[3][1]), (101, rows[3][1].replace("a", "e", 1)), (200, INSULT), (201, f"{INSULT} {INSULT}"), (300, f"config token = {SECRET} end"), (301, None), (302, ""), (None, "row of no id at all here")]
    docs = spark.createDataFrame([(i, t, "en", "src", None if t is None else len(t)) for i, t in rows], DOCS)
    docs.write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i in (200, 201))) for i in (*range(40), 200, 201)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return spark.read.parquet(f"{path}/documents.parquet"), rows


def test_stages(spark, tmp_path):
    docs, rows = made(spark, str(tmp_path))
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "line_dedup", "simhash_near_dedup", "secret_scan", "best_fit_packing"]
    seen = [docs]
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, seen[-1], str(tmp_path))
        out.write.parquet(str(tmp_path / f"out{k}"))
        seen.append(spark.read.parquet(str(tmp_path / f"out{k}")))
        if name != "best_fit_packing":
            assert seen[-1].columns == docs.columns
    ids = [{r.doc_id for r in x.select("doc_id").collect()} for x in seen]
    assert ids[1] == ids[0] - {200, 201}
    # line dedup keeps every row; each line stands once afterwards
    assert seen[2].count() == seen[1].count() and seen[2].where("n_chars <> length(text)").count() == 0
    lines = [x for r in seen[2].collect() for x in (r.text or "").split("\n") if len(x.split()) >= 4]
    assert len(lines) == len(set(lines))
    fps = [simhash.fingerprint(r.text or "") for r in seen[3].collect()]
    assert all((a ^ b).bit_count() > 3 for i, a in enumerate(fps) for b in fps[:i])
    assert {r.text for r in seen[4].collect() if r.doc_id == 300} == {"config [SECRET] end"} and seen[4].count() == seen[3].count()
    assert {r.doc_id for r in seen[5].collect()} == ids[4]
    whole = corpus_pipeline.run(spark, str(tmp_path))
    key = lambda df: sorted((str(r.doc_id), r.piece, r.length, r.ids_crc32) for r in df.collect())
    assert key(whole) == key(seen[5]) and len(rows) > whole.count() > 40


def test_empty_tables(spark, tmp_path):
    spark.createDataFrame([], DOCS).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([], "vec_id long, embedding array<float>, label int").write.parquet(str(tmp_path / "embeddings.parquet"))
    spark.createDataFrame([], "conv_id long, turn long, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    for name, f in QUERIES.items():
        assert f(spark, str(tmp_path)).count() == (1 if name == "op7_chat_formatting" else 0), name
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_registered():
    names = list(entry.queries())
    assert [n.split("_")[0] for n in names if n.startswith("op")] == [f"op{i}" for i in range(1, 11)] and "pipeline" in names
    assert all(m.__doc__ for m in (linededup, secrets, toxicity))
