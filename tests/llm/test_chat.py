import hashlib
import random

from pyspark.sql import functions as F

from leafmill.llm import chat

PARTS = ["</s>", "<s>", "[INST]", "[/INST]", "<~s>", "<~~/s>", "[~INST]", "<n>", "<~n>", "<<SYS>>", "<</SYS>>", "\n", "~", "<", "[", ">", "s>", "/s>", " ok ", "é", "$1", "\\"]


def test_escaping_is_reversible(spark):
    rng = random.Random(1)
    rows = [(i, "".join(rng.choices(PARTS, k=rng.randint(0, 9)))) for i in range(3000)]
    got = spark.createDataFrame(rows, "i int, t string").select("t", chat.escape(F.col("t")).alias("e")).select("t", "e", chat.unescape(F.col("e")).alias("b")).collect()
    for r in got:
        assert r.b == r.t
        assert not any(c in r.e for c in ("<s>", "</s>", "[INST]", "[/INST]", "<n>", "<<SYS>>", "<</SYS>>")), r


def fold(spark, rows):
    out = chat.fold(spark.createDataFrame(rows, "conv_id int, seq long, msg_id string, kind string, role string, text string"))
    return [(r.conv_id, r.msg_id, r.role, r.text) for r in out.orderBy("conv_id", "position").collect()]


def test_folding(spark):
    log = [
        (1, 1, "a", "open", "user", None), (1, 2, "a", "delta", None, "Hel"), (1, 4, "a", "delta", None, "lo"), (1, 3, "b", "open", "assistant", None),
        (1, 5, "b", "delta", None, "wrong"), (1, 6, "b", "regenerate", None, None), (1, 8, "b", "delta", None, "t"), (1, 7, "b", "delta", None, "righ"),
        (1, 9, "a", "edit", None, "Hi"), (1, 10, "a", "delta", None, "!"), (1, 11, "c", "open", "user", None), (1, 12, "c", "delete", None, None), (2, None, "d", None, None, "x"), (2, 5, "d", "odd", "tool", "y"),
    ]
    random.Random(2).shuffle(log)
    assert fold(spark, log) == [(1, "a", "user", "Hi!"), (1, "b", "assistant", "right"), (2, "d", "tool", "xy")]
    assert fold(spark, []) == []


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def test_digest(spark):
    rng = random.Random(3)
    rows = [(c, t, rng.choice(["user", "assistant", "system", None, "odd\n<s>role"]), None if rng.random() < 0.1 else "".join(rng.choices(PARTS, k=rng.randint(0, 12)))) for c in (0, 1, 2, None) for t in range(rng.randint(1, 9))]
    rows += [(5, 0, "assistant", ""), (6, 0, "assistant", "x" * 300_000)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, segments int")
    want = {}
    for c in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == c), key=lambda r: r[1])
        loss = "".join(r[3] or "" for r in own if r[2] == "assistant")
        want[c] = (len(own), sha("".join(f"{r[2] or ''}\n{r[3] or ''}\n" for r in own)), len(loss), sha(loss))
    got = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in chat.digest(df).collect()}
    assert got == want
    again = chat.digest(df.union(df.where("conv_id = 5"))).where("conv_id = 5").first()
    assert again.n_turns == 2 and chat.digest(df.limit(0)).count() == 0


def test_mask_covers_the_text(spark):
    df = spark.createDataFrame([(1, 0, "m", "user", "q"), (1, 1, "n", "assistant", "<s>a")], "conv_id int, position int, msg_id string, role string, text string")
    r = chat.render(df).first()
    assert r.formatted == "<s>user\nq</s>\n<s>assistant\n<~s>a</s>\n" == "".join(s.text for s in r.segments)
    assert [s.text for s in r.segments if s.loss] == ["<~s>a"]
