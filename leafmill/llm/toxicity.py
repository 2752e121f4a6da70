"""Toxicity by a weighted finite-state grammar over clauses.

A lexicon transducer turns the words of a clause into classes: insult, threat,
target, negation, reported speech, or nothing. Three more are composed with it:
one lowers what stands in the scope of a negation, one marks what is reported,
one raises what has a target near by. The composed machine reads a clause once
and gives its matches with their weights; a document's score comes from its
matched clauses, by a logistic function fitted on them.

Words for targets, negation and reported speech, and first words for insults and
threats, are stated here. Insults and threats of the corpus are learned from
labelled rows, as words or as stems, with their log odds as weights.
"""

from __future__ import annotations

import math
import re
from collections import defaultdict
from collections.abc import Iterable, Iterator
from itertools import product
from typing import NamedTuple

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafmill.llm._shared import text_of

# Words of each class in English, German, French and Spanish.
INSULTS = "idiot moron stupid scum loser pathetic worthless disgusting idiote dummkopf abschaum trottel imbécile crétin ordure imbécil basura estúpido".split()
THREATS = "kill hurt destroy punish töten vernichten tuer détruire matar destruir".split()
TARGETS = "you your yours they them he she du dich dein ihr euch sie er tu toi vous ton votre ils elle lui tú usted ustedes ellos ella él".split()
NEGATIONS = "not never no none without isn't aren't don't nicht nie kein keine ohne pas jamais sans aucun nunca jamás sin ningún".split()
REPORTS = "said says wrote quoted claimed reported alleged sagte schrieb behauptete laut dit écrit selon dijo escribió según".split()

#: Labelled rows of each class that the model is fitted on, at most, and their texts' bytes together.
SAMPLE_ROWS, SAMPLE_BYTES = 1500, 12 << 20
#: Weight of a stated word that the sample never shows.
PRIOR_WEIGHT = 2.0
STEMS = (4, 5, 6)
#: A learned entry must be in this share of the toxic groups of copies at least; its odds must be so many times as high,
#: and its log-likelihood ratio so far above what the most striking of all candidates has by chance.
LEAST_SHARE, LEAST_ODDS, LEAST_RATIO = 0.02, 15.0, 4.0
MOST_ENTRIES = 3000
SCOPE = 4

NOTHING, INSULT, THREAT, TARGET, NEGATION, REPORT = ".IHTNR"
KINDS = ["".join(x) for x in product("IH", ("", "~"), ("", "^"), ("", "@"))]

_WORD_BYTES = bytes(b if b >= 128 or chr(b).isalnum() or b == 39 else 32 for b in range(256))
_clauses = re.compile(r"[.!?;:\n]+").split


class Transducer:
    """Deterministic, with outputs on its arcs. ``step(state, symbol)`` gives (state, output); states are small numbers."""

    def __init__(self, arcs: dict[tuple[int, str], tuple[int, str]], start: int = 0):
        self.arcs, self.start = arcs, start

    def compose(self, after: Transducer) -> Transducer:
        """The machine that feeds what this one gives to ``after``, over the reachable pairs of states."""
        name: dict[tuple[int, int], int] = {(self.start, after.start): 0}
        queue, arcs = [(self.start, after.start)], {}
        symbols: dict[int, list] = defaultdict(list)
        for (s, x), (t, y) in self.arcs.items():
            symbols[s].append((x, t, y))
        for p, q in queue:
            for x, t, y in symbols[p]:
                u, z = after.arcs[q, y]
                if (t, u) not in name:
                    name[t, u] = len(name)
                    queue.append((t, u))
                arcs[name[p, q], x] = name[t, u], z
        return Transducer(arcs)

    def run(self, symbols: Iterable[str]) -> Iterator[str]:
        state = self.start
        for x in symbols:
            state, out = self.arcs[state, x]
            yield out


def _scope(trigger: str, alphabet: list[str], mark: str) -> Transducer:
    """Marks insults and threats that follow ``trigger`` within ``SCOPE`` symbols."""
    arcs = {}
    for left in range(SCOPE + 1):
        for x in alphabet:
            arcs[left, x] = (SCOPE, x) if x == trigger else (max(0, left - 1), x + mark if left and x[0] in "IH" else x)
    return Transducer(arcs)


def grammar() -> Transducer:
    """Negation, then reported speech, then targets. Reported speech marks the rest of its clause."""
    base = [NOTHING, INSULT, THREAT, TARGET, NEGATION, REPORT]
    negated = _scope(NEGATION, base, "~")
    after = [*base, "I~", "H~"]
    reported = Transducer({(s, x): (1 if x == REPORT else s, x + "^" if s and x[0] in "IH" else x) for s in (0, 1) for x in after})
    targeted = _scope(TARGET, [*after, *(x + "^" for x in after if x[0] in "IH")], "@")
    return negated.compose(reported).compose(targeted)


class Model(NamedTuple):
    words: dict[bytes, tuple[str, float]]
    stems: dict[bytes, tuple[str, float]]
    coefficients: tuple[float, ...]


def words_of(text: str) -> list[bytes]:
    return text.lower().encode().translate(_WORD_BYTES).split()


def _entry(word: bytes, model: Model) -> tuple[str, float] | None:
    """The word's own entry or the heaviest of its stems."""
    if found := model.words.get(word):
        return found
    stems = [model.stems[word[:n]] for n in STEMS if len(word) >= n and word[:n] in model.stems]
    return max(stems, key=lambda x: x[1]) if stems else None


class Scorer:
    def __init__(self, model: Model):
        self.model, self.machine = model, grammar()
        self.matched = {w for w, (c, _) in model.words.items() if c in (INSULT, THREAT)}
        self.known = {w.decode() for w in self.matched}
        self.cuts = sorted({len(s) for s in model.stems})

    def hit(self, words: set[bytes]) -> bool:
        """Whether any word could match; most texts end here."""
        if not self.matched.isdisjoint(words):
            return True
        return any(not self.model.stems.keys().isdisjoint({w[:n] for w in words}) for n in self.cuts)

    def features(self, text: str) -> np.ndarray:
        """For each kind of match, the logarithm of one and the sum over clauses of each clause's greatest weight; then whether there is any, and their rate."""
        out, words = np.zeros(len(KINDS) + 2), words_of(text)
        if not self.hit(set(words)):
            return out
        clauses = 0
        for clause in _clauses(text):
            own = words_of(clause)
            entries = [_entry(w, self.model) for w in own]
            if not any(e and e[0] in (INSULT, THREAT) for e in entries):
                continue
            best: dict[str, float] = {}
            for kind, e in zip(self.machine.run(e[0] if e else NOTHING for e in entries), entries):
                if kind[0] in "IH" and e[1] > best.get(kind, 0.0):
                    best[kind] = e[1]
            for kind, weight in best.items():
                out[KINDS.index(kind)] += weight
            clauses += bool(best)
        out[: len(KINDS)] = np.log1p(out[: len(KINDS)])
        out[-2], out[-1] = clauses > 0, math.log1p(100 * clauses / max(1, len(words)))
        return out

    def score(self, text: str) -> float:
        z = float(np.dot(self.model.coefficients[1:], self.features(text))) + self.model.coefficients[0]
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def _stated() -> dict[bytes, tuple[str, float]]:
    lists = ((INSULT, INSULTS), (THREAT, THREATS), (TARGET, TARGETS), (NEGATION, NEGATIONS), (REPORT, REPORTS))
    return {w.encode(): (c, PRIOR_WEIGHT) for c, ws in lists for w in ws}


class _Numbers(dict):
    """A number for each key, in the order of first use."""

    def __missing__(self, key):
        self[key] = n = len(self)
        return n


def _copy_groups(own: list[np.ndarray], hashed: np.ndarray) -> np.ndarray:
    """A group number for each document's words: those that share three least hashes of twelve count once, as copies do."""
    group = list(range(len(own)))

    def root(i: int) -> int:
        while group[i] != i:
            group[i] = i = group[group[i]]
        return i

    seen: dict[tuple, int] = {}
    for i, words in enumerate(own):
        h = hashed[words] if len(words) else np.zeros(1, np.uint64)
        least = [int((h * np.uint64(2 * k + 1) ^ h >> np.uint64(17 + k)).min()) for k in range(12)]
        for k in range(0, 12, 3):
            j = seen.setdefault((k, *least[k : k + 3]), i)
            if root(i) != root(j):
                group[root(i)] = root(j)
    return np.array([root(i) for i in range(len(own))], np.int64)


def _ratio(a: int, c: int, toxic: int, clean: int) -> float:
    """Log-likelihood ratio of being in a of the toxic and c of the clean groups, against one share in both."""

    def fit(k: int, n: int, p: float) -> float:
        return (k * math.log(p) if k else 0.0) + ((n - k) * math.log(1 - p) if k < n else 0.0)

    p = (a + c) / (toxic + clean)
    return 2 * (fit(a, toxic, a / toxic) + fit(c, clean, c / clean) - fit(a, toxic, p) - fit(c, clean, p))


def _proper(found: list[tuple], total: dict[tuple[bool, bytes], int]) -> list[tuple]:
    """Without stems that stand for one learned word, and without those of which a longer one is found as often."""
    words = {w for _, _, stem, w in found if not stem}
    longest = {w: a for _, a, stem, w in found if stem}
    out = []
    for x in found:
        _, a, stem, w = x
        if stem:
            most = max((total[False, v] for v in words if v.startswith(w)), default=0)
            if most >= 0.8 * total[True, w] or any(b >= 0.95 * a for v, b in longest.items() if v != w and v.startswith(w)):
                continue
        out.append(x)
    return out


def learn(rows: list[tuple[str, int]]) -> Model:
    """Lexicon and coefficients from (text, label). Copies count once; without both labels the stated words alone are used.

    Words and stems are numbers while they are counted, so the sample's texts
    are what takes most room.
    """
    stated = _stated()
    default = Model(stated, {}, (-4.0, *(1.5 if "~" not in k and "^" not in k else 0.2 for k in KINDS), 2.0, 0.0))
    label = np.array([y for _, y in rows], np.int64)
    number, stem_number = _Numbers(), _Numbers()
    own = [np.array(sorted({number[w] for w in words_of(t)}), np.int64) for t, _ in rows]
    words = list(number)
    groups = _copy_groups(own, np.array([xxhash.xxh3_64_intdigest(w) for w in words], np.uint64))
    names, at = np.unique(groups, return_inverse=True)
    toxic_group = np.zeros(len(names), np.int64)
    np.maximum.at(toxic_group, at, label)
    toxic = int(toxic_group.sum())
    clean = len(names) - toxic
    if not toxic or not clean:
        return default
    stems = np.full((len(words), len(STEMS)), -1, np.int64)
    for i, w in enumerate(words):
        for k, n in enumerate(STEMS):
            if len(w) > n:
                stems[i, k] = stem_number[w[:n]]
    counts = np.zeros((2, len(words) + len(stem_number)), np.int64)
    members: dict[int, list[np.ndarray]] = defaultdict(list)
    for g, ids in zip(at.tolist(), own):
        members[g].append(ids)
    for g, parts in members.items():
        ids = np.unique(np.concatenate(parts))
        found_stems = np.unique(stems[ids])
        counts[toxic_group[g], np.concatenate([ids, found_stems[found_stems >= 0] + len(words)])] += 1
    chance = LEAST_RATIO + 2 * math.log(max(2, counts.shape[1]))
    keys = list(stem_number)
    found, total = [], {}
    for i in np.flatnonzero(counts[1] >= max(1.0, LEAST_SHARE * toxic)).tolist():
        c, a = (int(x) for x in counts[:, i])
        stem = i >= len(words)
        w = keys[i - len(words)] if stem else words[i]
        odds = (a + 0.5) / (toxic - a + 0.5) / ((c + 0.5) / (clean - c + 0.5))
        if odds >= LEAST_ODDS and _ratio(a, c, toxic, clean) >= chance:
            total[stem, w] = a + c
            found.append((math.log(odds), a, stem, w))
    found = _proper(found, total)
    found = sorted(found, key=lambda x: (-x[1] * x[0], x[3]))[:MOST_ENTRIES]
    known = stated | {w: (THREAT if stated.get(w, "")[:1] == (THREAT,) else INSULT, round(x, 4)) for x, _, stem, w in found if not stem}
    known_stems = {w: (INSULT, round(x, 4)) for x, _, stem, w in found if stem}
    scorer = Scorer(Model(known, known_stems, default.coefficients))
    size = np.bincount(at)[at]
    x = np.array([scorer.features(t) for t, _ in rows])
    return Model(known, known_stems, _logistic(x, label.astype(float), 1 / size))


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1.0) -> tuple[float, ...]:
    """Ridge logistic regression by Newton's method, both labels of equal weight."""
    x = np.column_stack([np.ones(len(x)), x])
    weight = weight * np.where(y > 0, 0.5 / (weight * y).sum(), 0.5 / (weight * (1 - y)).sum()) * len(y)
    b, penalty = np.zeros(x.shape[1]), np.diag([1e-6] + [ridge] * (x.shape[1] - 1))
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        step = np.linalg.solve(x.T @ (x * (weight * p * (1 - p))[:, None]) + penalty, x.T @ (weight * (y - p)) - penalty @ b)
        b += step
        if np.abs(step).max() < 1e-8:
            break
    return tuple(float(round(v, 6)) for v in b)


def held_out():
    """Whether a row's label must not be learned from: crc32 of the doc_id as text, modulo 5, is 0; null counts as empty text."""
    return F.pmod(F.crc32(F.encode(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "UTF-8")), F.lit(5)) == 0


def training_sample(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS, most_bytes: int = SAMPLE_BYTES) -> list[tuple[str, int]]:
    """At most ``rows`` labelled texts of each class that aren't held out, by the order of a hash of their ids, within ``most_bytes``."""
    marks = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    sizes = docs.where(F.col("text").isNotNull() & ~held_out()).groupBy("doc_id").agg(F.min(F.octet_length("text")).alias("bytes"))
    marked = sizes.join(marks, "doc_id").withColumn("order", F.xxhash64("doc_id"))
    picked = marked.where("toxic = 1").orderBy("order", "doc_id").limit(rows).union(marked.where("toxic = 0").orderBy("order", "doc_id").limit(rows)).collect()
    kept, room = {}, {0: most_bytes // 2, 1: most_bytes // 2}
    for x in sorted(picked, key=lambda x: (x.order, x.doc_id)):
        if x.bytes <= room[x.toxic]:
            room[x.toxic] -= x.bytes
            kept[x.doc_id] = (x.toxic, x.bytes)
    if not kept:
        return []
    spark = docs.sparkSession
    wanted = spark.createDataFrame([(i, y, n) for i, (y, n) in kept.items()], "doc_id long, toxic int, bytes int")
    # at most 2 * rows short rows
    texts = docs.where(F.col("text").isNotNull()).select("doc_id", "text").join(F.broadcast(wanted), "doc_id").where(F.octet_length("text") == F.col("bytes"))
    one = texts.groupBy("doc_id").agg(F.min("text").alias("text"), F.first("toxic").alias("toxic"))
    return [(x.text, x.toxic) for x in one.orderBy("doc_id").collect()]


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    return learn(training_sample(docs, labels))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``(doc_id, held_out, score, predicted)``, one row for each row.

    Null texts count as empty and get the score of a text without matches; null
    and repeated doc_ids stay; texts of any length are read whole.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scorer = Scorer(model)
        for x in batches:
            s = [scorer.score(t) for t in x["text"]]
            yield pd.DataFrame({"doc_id": x["doc_id"], "held_out": x["held_out"], "score": s, "predicted": [int(v >= 0.5) for v in s]})

    return docs.select("doc_id", held_out().alias("held_out"), text_of().alias("text")).mapInPandas(run, "doc_id long, held_out boolean, score double, predicted int")


def reject(docs: DataFrame, model: Model) -> DataFrame:
    """The documents that aren't predicted to be toxic, with all their columns."""

    @F.pandas_udf("boolean")
    def clean(texts: pd.Series) -> pd.Series:
        scorer = Scorer(model)
        return texts.map(lambda t: scorer.score(t) < 0.5).astype(bool)

    return docs.where(clean(text_of()))
