import random

import corpus_pipeline
import numpy as np
import pytest
import xxhash

from leafmill.llm import _shared, allpairs, components, linededup, sharding, simhash
from leafmill.llm._shared import together
from tests.llm.conftest import CLEAN


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def test_components(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(1000, 1200)] + [(5000, 5000), (None, 1), (7, 7)]
    edges += [(2000, i) for i in range(2001, 2300)] * 2
    links = simhash.Links()
    for a, b in edges:
        if a is not None and a != b:
            links.add(a, b)
    nodes = {x for e in edges if e[0] is not None and e[0] != e[1] for x in e}
    got = {r.node: r.root for r in components.connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert {n: got.get(n, n) for n in nodes} == {n: links.root(n) for n in nodes}
    assert components.connected_components(spark.createDataFrame([], "u long, v long")).count() == 0


def plain_fingerprint(text):
    words = text.encode().lower().split()
    grams = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([b" ".join(words)] if words else [])
    h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_fingerprints(spark, edge):
    for t in ("", " \x0b\n", "one", "One two", "A b C d e", CLEAN, "É é ß x y", "a a a a a"):
        assert simhash.fingerprint(t) == plain_fingerprint(t)
    got = simhash.near_duplicates(edge)
    assert sorted(r.fingerprint for r in got.collect()) == sorted(format(plain_fingerprint(r.text or ""), "016x") for r in edge.collect())
    group = {}
    for r in got.collect():
        group.setdefault(r.fingerprint, set()).add(r.component_id)
    assert group["0" * 16] == {2} and group[format(plain_fingerprint(CLEAN), "016x")] == {1}
    assert simhash.near_duplicates(edge.limit(0)).count() == 0


@pytest.mark.parametrize(("short", "long"), [(24, 4096), (2, 10), (2, 60)])
def test_near_groups(spark, monkeypatch, short, long):
    monkeypatch.setattr(simhash, "SHORT_RUN", short)
    monkeypatch.setattr(simhash, "LONG_RUN", long)
    rng = random.Random(3)
    values = {rng.getrandbits(64) for _ in range(200)} | {0, (1 << 64) - 1}
    for centre in [rng.getrandbits(64) for _ in range(12)]:
        for _ in range(70):
            for b in rng.sample(range(64), rng.randint(0, 6)):
                centre ^= 1 << b if rng.random() < 0.6 else 0
            values.add(centre)
    values = sorted(values)
    links, a = simhash.Links(), np.array(values, np.uint64)
    for i in range(len(a)):
        for j in np.flatnonzero(np.bitwise_count(a[i] ^ a[i + 1 :]) <= 3) + i + 1:
            links.add(i, int(j))
    df = spark.createDataFrame([(i, signed(v)) for i, v in enumerate(values)], "doc_id long, fingerprint long")
    got = {r.fingerprint: r.component_id for r in simhash.near_groups(df).collect()}
    assert [got[signed(v)] for v in values] == [links.root(i) for i in range(len(values))]


def test_links_stay_few(spark):
    """Of a dense group no more links are passed on than connect it, for each key."""
    base, near = 0x0123456789ABCDEF, []
    near = [signed(base ^ (1 << i) ^ (1 << j)) for i in range(32) for j in range(i)]
    df = spark.createDataFrame([(v,) for v in near], "fingerprint long")
    assert simhash.fingerprint_links(df).count() < 20 * len(near)


def test_keep_one(spark, edge):
    left = simhash.keep_one(edge)
    assert left.columns == edge.columns
    got = sorted((r.doc_id, (r.text or "")[:5]) for r in left.collect())
    assert got == sorted([(1, CLEAN[:5]), (2, ""), (4, CLEAN[:5]), (5, "token"), (6, "xxxxx"), (7, "क़ 👍🏽"[:5]), (-8, "w0 w1")])
    assert simhash.keep_one(edge.limit(0)).count() == 0
    nulls = spark.createDataFrame([(None, "a b c d"), (None, "x y z w"), (None, "a b c d")], "doc_id long, text string")
    assert sorted(r.text for r in simhash.keep_one(nulls).collect()) == ["a b c d", "x y z w"]


def plain_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_edit_distance():
    rng = random.Random(4)
    for _ in range(1500):
        a = "".join(rng.choices("abc ", k=rng.randint(0, 16)))
        b = list(a) if rng.random() < 0.7 else rng.choices("abc ", k=rng.randint(0, 16))
        for _ in range(rng.randint(0, 4)):
            k = rng.randint(0, len(b))
            b[k : k + rng.randint(0, 1)] = rng.choices("abcd", k=rng.randint(0, 1))
        b, most = "".join(b), rng.randint(0, 9)
        d = plain_distance(a, b)
        assert linededup.edit_distance(a, b, most) == min(d, most + 1)
        long = "".join(rng.choices("abcd ", k=300))
        near = "".join(c for c in long if rng.random() < 0.9)
        assert rng.random() < 0.95 or linededup.edit_distance(long, near, most * 8) == min(plain_distance(long, near), most * 8 + 1)
        if a and b:
            assert linededup._bit_parallel(a, b) == d and min(linededup._diagonals(a, b, most), most + 1) == min(d, most + 1)
        a, b = " ".join(a.split()), " ".join(b.split())
        assert linededup.similar(a, b, 0.8) == (plain_distance(a, b) <= int(0.2 * max(len(a), len(b)) + 1e-9))
        assert linededup.aligned_bound(a.split(), b.split(), 99) >= plain_distance(a, b)
    a = "word " * 5000
    assert linededup.edit_distance(a, a[:9000] + "x" + a[9000:], 500) == 1


def lines_kept(spark, rows, **more):
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    return {r.doc_id: r.text for r in together(linededup.deduplicate(docs, **more), docs.columns).collect()}


def test_line_dedup(spark):
    a = "the quick brown fox jumps over the lazy dog near the old river bank today"
    b = "the quick brown fox jumps over the lazy dog near the old river bank Monday!"
    c = "today bank river old the near dog lazy the over jumps fox brown quick the"
    got = lines_kept(spark, [(2, f"{a}\nshort line\n{c}"), (1, f"{b}\nshort line"), (3, f"THE quick,  brown FOX jumps over the lazy dog near the old river bank today\n{a}"), (4, None), (5, "")])
    assert got == {1: f"{b}\nshort line", 2: f"short line\n{c}", 3: "", 4: None, 5: ""}


def close_lines(names, least=0):
    """Components of all pairs by plain edit distance that have ``least`` keys in common."""
    links = simhash.Links()
    n, keys = linededup.keys_of([x.encode().split() for x in names])
    each = [set(k.tolist()) for k in np.split(keys, np.cumsum(n)[:-1])]
    for i, a in enumerate(names):
        for j, b in enumerate(names[:i]):
            most = int(0.2 * max(len(a), len(b)) + 1e-9)
            if abs(len(a) - len(b)) <= most and len(each[i] & each[j]) >= least and linededup._bit_parallel(a, b) <= most:
                links.add(i, j)
    return [links.root(i) for i in range(len(names))]


@pytest.mark.parametrize("star", [512, 8])
def test_line_dedup_against_all_pairs(spark, monkeypatch, star):
    """Lines with one word changed, repeatedly: chains, groups of many and lines that share words but aren't similar."""
    monkeypatch.setattr(linededup, "STAR", star)
    rng = random.Random(6)
    vocabulary = ["".join(rng.choices("abcdefghij", k=rng.randint(2, 7))) for _ in range(60)]
    names = set()
    for n in (4, 5, 9, 14, 30, 90, 140):
        for _ in range(3):
            words = rng.choices(vocabulary, k=n)
            for _ in range(14):
                words = list(words) if rng.random() < 0.6 else rng.choices(vocabulary, k=n // 2) + words[n // 2 :]
                k = rng.randrange(len(words))
                words[k : k + rng.randint(0, 1)] = [rng.choice(vocabulary)]
                names.add(" ".join(words))
    names = rng.sample(sorted(names), len(names))
    roots, whole = close_lines(names, 1), close_lines(names)
    got = lines_kept(spark, list(enumerate(names)))
    assert [got[i] != "" for i in range(len(names))] == [r == i for i, r in enumerate(roots)]
    # of what all pairs would remove, whether they meet or not
    assert len(names) - len(set(roots)) >= 0.95 * (len(names) - len(set(whole))) > len(names) // 3


def changed(rng, line, kind):
    words = line.split()
    if kind == "letter":
        k = rng.randrange(len(line))
        return " ".join((line[:k] + rng.choice("xqz") + line[k + 1 :]).split())
    if kind == "word":
        words.insert(rng.randint(0, len(words)), rng.choice(words))
    else:
        for k in rng.sample(range(len(words)), len(words) // 10 or 1):
            words[k] = words[k][::-1] + "y"
    return " ".join(words)


def test_lines_meet(spark):
    """Of lines within the similarity, the share that has a key in common, by length and change; texts as in the test tables."""
    import duckdb

    texts = duckdb.sql("SELECT text FROM '/root/testdata/sf0.01/documents.parquet' WHERE text IS NOT NULL ORDER BY doc_id").fetchall()
    lines = sorted({b" ".join(w).decode() for (t,) in texts for w in linededup.normalised_lines(t) if len(w) >= 4})
    rng, least = random.Random(7), {}
    for low, high in ((4, 7), (8, 12), (13, 20), (21, 40), (41, 80), (81, 200), (201, 10**6)):
        own = [x for x in lines if low <= len(x.split()) <= high]
        for kind in ("letter", "word", "tenth"):
            pairs = [(x, changed(rng, x, kind)) for x in rng.sample(own, min(200, len(own)))]
            pairs = [(a, b) for a, b in pairs if linededup._bit_parallel(a, b) <= int(0.2 * max(len(a), len(b)) + 1e-9)]
            n, keys = linededup.keys_of([x.encode().split() for pair in pairs for x in pair])
            each = [set(k.tolist()) for k in np.split(keys, np.cumsum(n)[:-1])]
            least[low, kind] = sum(bool(each[i] & each[i + 1]) for i in range(0, len(each), 2)) / len(pairs)
    assert min(least.values()) >= 0.9, least


@pytest.mark.parametrize("run", [1 << 16, 3])
def test_stars(monkeypatch, run):
    import pyarrow as pa

    monkeypatch.setattr(linededup, "_RUN", run)
    rng = random.Random(5)
    rows = sorted(((rng.choice([1, 2, 2, 2, 3, 4, 9, 9]), rng.randrange(40)) for _ in range(300)), key=lambda r: r[0])
    batches = [pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows[k : k + 7])], ["key", "k"]) for k in range(0, len(rows), 7)]
    links = simhash.Links()
    for out in linededup._stars(iter(batches)):
        for c, k, key in zip(*out.to_pydict().values()):
            assert (key, c) in rows and (key, k) in rows and c != k
            links.add(key * 100 + c, key * 100 + k)
    for key in {r[0] for r in rows}:
        assert len({links.root(key * 100 + k) for own, k in rows if own == key}) == 1


def test_unlike_lines_of_one_key_are_compared_fast():
    import time

    import pyarrow as pa

    rng = random.Random(9)
    texts = ["".join(rng.choices("abcdefgh ijklmnop", k=120)) for _ in range(400)]
    texts[399] = texts[200][:60] + "xyz" + texts[200][60:]
    batch = pa.RecordBatch.from_arrays([pa.array([7] * 400), pa.array([0] + [1] * 399), pa.array(range(400)), pa.array(texts), pa.array([[]] + [[1, 2]] * 399, pa.list_(pa.int64()))], ["g", "side", "node", "text", "keys"])
    start = time.time()
    (out,) = linededup._compared(iter([batch]), 0.8)
    assert [tuple(sorted(p)) for p in zip(*out.to_pydict().values()) if p[1] is not None] == [(200, 399)] and time.time() - start < 2


def test_words_and_their_hashes(monkeypatch):
    rng = random.Random(3)
    texts = ["", "\n", "a", "A b\n\nc1-d", " x  y\n", *("".join(rng.choices("ab c\né\t", k=rng.randint(0, 60))) for _ in range(300)), "long" * 40]
    whole = {}
    for size in (1 << 20, 7):
        monkeypatch.setattr(linededup, "_BYTES_AT_ONCE", size)
        for t in texts:
            line, n, h, g = linededup.words_of(linededup.plain_text(t))
            words = [(k, w) for k, ws in enumerate(linededup.normalised_lines(t)) for w in ws]
            assert list(zip(line, n)) == [(k, len(w)) for k, w in words]
            for (_, w), *both in zip(words, h.tolist(), g.tolist()):
                assert whole.setdefault(w, both) == both
    assert len({x for x, _ in whole.values()}) == len({y for _, y in whole.values()}) == len(whole)


def test_simhashes():
    rng = np.random.default_rng(4)
    sizes = np.concatenate([rng.integers(0, 9, 200), rng.integers(0, 90, 40), [0, 1, 64, 65, 1000]])
    hashed = rng.integers(0, 1 << 64, int(sizes.sum()), np.uint64)
    got, at = linededup.simhashes(hashed, sizes), 0
    for n, x in zip(sizes, got):
        own = [int(h) for h in hashed[at : at + n]]
        at += n
        assert int(x) == sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in own) > len(own))


def test_line_dedup_finds_all_short_pairs(spark):
    """Pairs are chosen by edit similarity alone, whatever their hashes."""
    rng = random.Random(8)
    vocabulary = ["".join(rng.choices("abcdefgé", k=rng.randint(1, 6))) for _ in range(60)]
    names = set()
    for _ in range(40):
        line = " ".join(rng.choices(vocabulary, k=rng.randint(4, 18)))
        for _ in range(4):
            near = list(line)
            for _ in range(rng.randint(0, len(near) // 6)):
                k = rng.randrange(len(near))
                near[k : k + rng.randint(0, 1)] = rng.choices("abcx ", k=rng.randint(0, 1))
            words = "".join(near).split()
            if len(words) >= linededup.MIN_WORDS and len(" ".join(words)) <= linededup.REACH:
                names.add(" ".join(words))
    names, links = sorted(names), simhash.Links()
    rng.shuffle(names)
    for i, a in enumerate(names):
        for j, b in enumerate(names[:i]):
            if plain_distance(a, b) <= int(0.2 * max(len(a), len(b)) + 1e-9):
                links.add(i, j)
    want = [links.root(i) == i for i in range(len(names))]
    got = lines_kept(spark, list(enumerate(names)), reach=linededup.REACH)
    assert [got[i] != "" for i in range(len(names))] == want and sum(want) < len(names) - 40
    digest = linededup.digest(spark.createDataFrame(list(enumerate(names)), "doc_id long, text string"))
    assert {r.doc_id for r in digest.where("n_dropped = 0").collect()} == {i for i, w in enumerate(want) if w}


def test_line_dedup_of_few_words(spark):
    rows = [(1, "Home\nabout us\n\nhome page 12"), (2, "HOME!\nabout  us\n\n---"), (3, "home page 34\nhome pages 1\n---\nhome")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = {1: [], 2: [0, 1], 3: [0, 3]}
    assert {r.doc_id: r.dropped for r in linededup.digest(docs).collect()} == want
    texts = {r.doc_id: r.text for r in corpus_pipeline.dedup_lines(spark, docs, "").collect()}
    assert texts == {i: "\n".join(x for k, x in enumerate(t.split("\n")) if k not in want[i]) for i, t in rows}


def test_line_dedup_edges(spark, edge):
    out = together(linededup.deduplicate(edge), edge.columns)
    assert out.columns == edge.columns and out.count() == edge.count()
    got = {}
    for r in out.collect():
        got.setdefault(r.doc_id, []).append(r.text)
    assert got[1] == [CLEAN] and got[2] == [None] and got[3] == [""] and sorted(map(str, got[None])) == ["", "None"] and len(got[5]) == 2 and got[5][0] == got[5][1]
    assert linededup.digest(edge).count() == edge.count() and linededup.digest(edge.limit(0)).count() == 0


def test_room_tree():
    rng, tree, own = random.Random(7), sharding.RoomTree(), []
    for _ in range(2000):
        if own and rng.random() < 0.45:
            x = own.pop(rng.randrange(len(own)))
            tree.remove(x)
        else:
            x = (rng.randrange(100), rng.randrange(10**9))
            own.append(x)
            tree.add(x)
        want = rng.randrange(110)
        assert tree.at_least(want) == min((y for y in own if y[0] >= want), default=None) and tree.largest() == max(own, default=None)

    def depth(t):
        return 1 + max(depth(t[0]), depth(t[2])) if t else 0

    assert depth(tree.root) <= 3 * np.log2(len(own) + 2)


def test_best_fit_decreasing():
    rng = random.Random(8)
    for _ in range(60):
        sizes = [rng.randint(1, 30) for _ in range(rng.randint(0, 60))]
        bins, want = [], {}
        for s in sorted(sizes, reverse=True):
            fit = [(r, i) for i, r in enumerate(bins) if r >= s]
            i = min(fit)[1] if fit else len(bins)
            if not fit:
                bins.append(32)
            bins[i] -= s
            want.setdefault(s, []).append(i)
        groups = [(f"g{k}", s) for k, s in enumerate(sizes)]
        got: dict[int, list[int]] = {}
        for name, shard in sharding.fewest_shards(groups, 32).items():
            got.setdefault(dict(groups)[name], []).append(shard)
        assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in want.items()}


def test_sharding(spark, edge):
    rng = random.Random(9)
    rows = [(i, "x" * rng.choice([0, 1, 5, 300, 2500, 5000, 9000]) + str(i % 700)) for i in range(2000)] + [(9000 + i, "hot" * 50) for i in range(600)] + [(None, None)] * 3
    got = sharding.shard_documents(spark.createDataFrame(rows, "doc_id long, text string"), 40).toPandas()
    assert len(got) == len(rows)
    sizes = got.groupby("shard")["size"].sum()
    hot = 600 * (150 + 16)
    assert len(sizes) == 40 and got.groupby("text_crc32").shard.nunique().max() == 1
    others = sizes[sizes != sizes.max()] if sizes.max() >= hot and hot > sizes.sum() / 40 else sizes
    assert others.max() - others.min() <= 1400
    assert all(sorted(v) == list(range(len(v))) for _, v in got.groupby("shard").slot)
    edges = sharding.shard_documents(edge, 40)
    assert edges.count() == edge.count() and sharding.shard_documents(edge.limit(0), 40).count() == 0


def test_line_dedup_query_finds_all_pairs(spark, tmp_path, monkeypatch):
    """Long lines with a changed letter in nearly every word share no key of words, yet are within the similarity."""
    from leafmill.llm.queries import op1_line_dedup

    monkeypatch.setattr(linededup, "_BLOCK_LINES", 9)
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("aeioudlmnrst") for _ in range(rng.randint(4, 8)))
    lines = [" ".join(word() for _ in range(rng.choice((5, 9, 25, 60)))) for _ in range(30)]
    changed = lambda x, k: " ".join(w[:at] + "q" * k + w[at + k :] for w in x.split() for at in [rng.randrange(len(w) - 1)])
    lines += [changed(x, 1) for x in lines] + [changed(x, 2) for x in lines[:15]]
    spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    root = list(range(len(lines)))
    for i, x in enumerate(lines):
        for j in range(i):
            if root[i] != root[j] and linededup.similar(lines[j], x):
                root = [min(root[i], root[j]) if r in (root[i], root[j]) else r for r in root]
    got = {r.doc_id: r.n_dropped for r in op1_line_dedup(spark, str(tmp_path)).collect()}
    assert got == {i: int(root[i] != i) for i in range(len(lines))} and sum(got.values()) >= 20


def test_all_pairs_shuffle_each_line_once(spark, monkeypatch):
    """A line meets all lines of like lengths; copies for each of these meetings would fill the disks."""
    monkeypatch.setattr(linededup, "_BLOCK_LINES", 5)
    rng = random.Random(2)
    texts = ["".join(rng.choices("abcde", k=rng.choice((20, 21, 60)))) for _ in range(100)]
    lines = list(enumerate([*texts, *("f" + x[:9] + "f" + x[10:] for x in texts)]))
    within = lambda a, b: abs(len(a) - len(b)) <= 12 and plain_distance(a, b) <= int(0.2 * max(len(a), len(b)) + 1e-9)
    links = linededup.all_links(spark.createDataFrame(lines, "node long, text string"), linededup.SIMILARITY)
    plan = links._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "CartesianProduct" in plan
    tables = [p for _, p in _shared._written if "/blocks-" in p]
    sizes = [len(r.nodes) // 8 for r in spark.read.parquet(tables[-1]).collect()]
    assert len(sizes) > 20 and sum(sizes) == len(lines)
    root = simhash.Links()
    for r in links.collect():
        assert within(lines[r.u][1], lines[r.v][1])
        root.add(r.u, r.v)
    near = [(i, j) for i, a in lines for j, b in lines[:i] if within(a, b)]
    assert len(near) >= 100 and all(root.root(i) == root.root(j) for i, j in near)


def test_all_pairs_of_blocks():
    """No near pair is lost before it is verified, and verification is exact; alphabets with many common segments, lines of one to many words of bits."""
    rng = random.Random(4)
    for alphabet in ("ab ", "etaoin shrdlu", "abcdefgh é中👍"):
        texts = set()
        for size in (1, 2, 3, 9, 40, 64, 65, 130, 400):
            for _ in range(3):
                line = rng.choices(alphabet, k=size)
                for _ in range(4):
                    near = list(line)
                    for _ in range(rng.randint(0, size // 4 + 1)):
                        k = rng.randrange(len(near) + 1)
                        near[k : k + rng.randint(0, 1)] = rng.choices(alphabet, k=rng.randint(0, 1))
                    texts.add(" ".join("".join(near).split()))
        texts = sorted(texts - {""})
        rng.shuffle(texts)
        half = len(texts) // 2
        a, b = allpairs.Block(np.arange(half), texts[:half], 0.8), allpairs.Block(np.arange(half, len(texts)), texts[half:], 0.8)
        for one, other in ((a, b), (b, a), (a, a)):
            met = [(i, j) for x, y in allpairs.candidates(one, other) for i, j in zip(x.tolist(), y.tolist())]
            assert len(met) == len(set(met))
            names = [[texts[k] for k in side.nodes] for side in (one, other)]
            symbols = np.unique(np.concatenate([one.codes.ravel(), other.codes.ravel()]), return_inverse=True)[1].astype(np.int32)
            x, y = symbols[: one.codes.size].reshape(one.codes.shape), symbols[one.codes.size :].reshape(other.codes.shape)
            i, j = np.array(met).T
            found = {(p, q) for p, q, good in zip(i.tolist(), j.tolist(), allpairs.near(x, one.lengths, i, y.T, other.lengths, j, one.most[i])) if good}
            later = lambda p, q: (len(names[0][p]), one.nodes[p]) > (len(names[1][q]), other.nodes[q])  # noqa: E731, B023
            want = {(p, q) for p in range(len(names[0])) for q in range(len(names[1])) if later(p, q) and len(names[0][p]) - len(names[1][q]) <= one.most[p] and plain_distance(names[0][p], names[1][q]) <= one.most[p]}
            assert found == want and want


def test_unlike_long_lines_are_seldom_verified():
    """Long lines of the same few syllables share most segments, but not where the edits allowed could have moved them."""
    rng = random.Random(6)
    syllables = [x + y for x in "bdfghklmnprstvw" for y in "aeiou"]
    rng.shuffle(syllables)
    words = ["".join(rng.choices(syllables[:24], k=rng.randint(1, 4))) for _ in range(300)]
    texts = [" ".join(rng.choices(words, k=300))[:400] for _ in range(256)]
    a, b = allpairs.Block(np.arange(128), texts[:128], 0.8), allpairs.Block(np.arange(128, 256), texts[128:], 0.8)
    met = sum(len(i) for x, y in ((a, b), (b, a)) for i, _ in allpairs.candidates(x, y))
    assert met < 0.01 * 128 * 128


def test_blocks_in_order_of_length():
    """Only the shorter block has a table; lines of equal length meet across the two, whatever their nodes."""
    rng = random.Random(8)
    texts = ["".join(rng.choices("abcdefgh ", k=k)).replace(" ", "x") for k in (40, 60, 60, 60, 70, 700)]
    near = ["zz" + x[2:] for x in texts[1:4]] + [texts[4] + "zz", texts[5][:300] + texts[5][310:] + "z" * 9 + "y" * 41]
    for nodes in (range(len(near)), range(100, 100 + len(near))):
        short, long = allpairs.Block(np.arange(50, 54), texts[:4], 0.8), allpairs.Block(np.array(nodes), near, 0.8)
        for links in (allpairs.links_of(short, long), allpairs.links_of(long, short)):
            assert {frozenset(x) for x in links} == {frozenset((51 + k, nodes[k])) for k in range(3)}
        assert long._table is None
    for texts in (["a" * 3000, "a" * 2900 + "b" * 100], ["ab" * 1500, "ba" * 1700]):
        assert len(allpairs.links_of(*(allpairs.Block(np.array([k]), [x], 0.8) for k, x in enumerate(texts)))) == 1
