"""Transliteration of nine Brahmi-derived scripts into Latin letters, as spoken.

The nine blocks are aligned, so a character is known by its offset in its block.
A word is a row of sounds, each a consonant, a written vowel, an inherent vowel,
a nasal or breath sign, or something else. Inherent vowels that modern languages
no longer speak are dropped, and a nasal sign takes the sound of what follows.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Blocks by their first character, and those whose languages drop the last inherent vowel, or also inner ones.
BLOCKS = (0x0900, 0x0980, 0x0A00, 0x0A80, 0x0B00, 0x0B80, 0x0C00, 0x0C80, 0x0D00)
DROP_LAST = frozenset((0x0900, 0x0980, 0x0A00, 0x0A80, 0x0B00))
DROP_INNER = frozenset((0x0900,))

# Sounds by offset in a block. Consonants run from 0x15.
CONSONANTS = dict(enumerate("k kh g gh ṅ c ch j jh ñ ṭ ṭh ḍ ḍh ṇ t th d dh n ṉ p ph b bh m y r ṟ l ḷ ḻ v ś ṣ s h".split(), 0x15))
VOWELS = {0x05: "a", 0x06: "ā", 0x07: "i", 0x08: "ī", 0x09: "u", 0x0A: "ū", 0x0B: "ṛ", 0x0C: "ḷ", 0x0D: "ê", 0x0F: "e", 0x10: "ai", 0x11: "ô", 0x13: "o", 0x14: "au"}
VOWEL_SIGNS = {0x3E: "ā", 0x3F: "i", 0x40: "ī", 0x41: "u", 0x42: "ū", 0x43: "ṛ", 0x45: "ê", 0x46: "e", 0x47: "e", 0x48: "ai", 0x49: "ô", 0x4A: "o", 0x4B: "o", 0x4C: "au"}
SIGNS = {0x01: "m̐", 0x02: "ṃ", 0x03: "ḥ", 0x3D: "'"}
STOPS = {0x64: ".", 0x65: ".."}
NUKTA, VIRAMA, DIGITS = 0x3C, 0x4D, range(0x66, 0x70)
DOTTED = {"k": "q", "kh": "x", "g": "ġ", "j": "z", "ḍ": "ṛ", "ḍh": "ṛh", "ph": "f", "r": "ṟ"}
# Two Gurmukhi signs that have no counterpart at their offset.
TIPPI, ADDAK = 0x0A70, 0x0A71
# The nasal spoken before each row of stops.
NASALS = {c: n for n, row in (("ṅ", "k kh g gh ṅ"), ("ñ", "c ch j jh ñ"), ("ṇ", "ṭ ṭh ḍ ḍh ṇ"), ("n", "t th d dh n"), ("m", "p ph b bh m")) for c in row.split()}

CONSONANT, VOWEL, INHERENT, SIGN, OTHER = "CVASO"


class _Word:
    def __init__(self):
        self.kinds: list[str] = []
        self.sounds: list[str] = []
        self.block: int | None = None

    def add(self, kind: str, sound: str) -> None:
        self.kinds.append(kind)
        self.sounds.append(sound)

    def mute(self) -> None:
        """Takes back an inherent vowel that has just been added."""
        if self.kinds and self.kinds[-1] == INHERENT:
            self.kinds.pop()
            self.sounds.pop()

    def dot(self) -> None:
        """Alters the last consonant."""
        for i in reversed(range(len(self.kinds))):
            if self.kinds[i] == CONSONANT:
                self.sounds[i] = DOTTED.get(self.sounds[i], self.sounds[i])
                return

    def spoken(self, drop: bool) -> str:
        kinds, sounds = self.kinds, self.sounds
        if drop and self.block in DROP_LAST:
            silent = silent_vowels("".join(kinds), self.block in DROP_INNER)
            kinds = [k for i, k in enumerate(kinds) if i not in silent]
            sounds = [s for i, s in enumerate(sounds) if i not in silent]
        out = []
        for i, s in enumerate(sounds):
            if kinds[i] == SIGN and s == "ṃ" and i + 1 < len(kinds) and kinds[i + 1] == CONSONANT:
                s = NASALS.get(sounds[i + 1], s)
            out.append(s)
        return "".join(out)


def silent_vowels(kinds: str, inner: bool) -> set[int]:
    """Places of the inherent vowels that aren't spoken, decided from the end of the word.

    The last one goes if nothing but other signs follows and another vowel is
    left. One within goes if a vowel stands somewhere before its consonant, and
    exactly one consonant and no nasal stand between it and a next vowel that is
    spoken; the first that stays keeps all before it.
    """
    silent: set[int] = set()
    vowels = [i for i, k in enumerate(kinds) if k in (VOWEL, INHERENT)]
    for n in reversed(range(len(vowels))):
        i = vowels[n]
        if kinds[i] != INHERENT:
            continue
        if n == len(vowels) - 1:
            after = kinds[i + 1 :]
            if CONSONANT not in after and SIGN not in after and len(vowels) > 1:
                silent.add(i)
            continue
        if not inner:
            break
        follows = vowels[n + 1]
        between = kinds[i + 1 : follows]
        before = any(v <= i - 2 for v in vowels[:n])
        if i and kinds[i - 1] == CONSONANT and before and follows not in silent and between.count(CONSONANT) == 1 and SIGN not in between:
            silent.add(i)
        else:
            break
    return silent


def transliterate(text: str | None, drop: bool = True) -> str:
    """Other characters pass and end the word; unmapped ones of the nine blocks are left out. ``drop``: leave silent vowels out."""
    out: list[str] = []
    word, doubled = _Word(), False

    def flush(more: str) -> _Word:
        out.append(word.spoken(drop))
        out.append(more)
        return _Word()

    for ch in text or "":
        point = ord(ch)
        block = point & ~0x7F if 0x0900 <= point < 0x0D80 else None
        at = point & 0x7F
        if point == TIPPI:
            word.add(SIGN, "ṃ")
        elif point == ADDAK:
            doubled = True
        elif block in (0x0980, 0x0A00, 0x0A80, 0x0B00) and at == NUKTA:
            word.dot()
        elif block is None:
            word = flush(ch)
        else:
            word.block = block if word.block is None else word.block
            if at in DIGITS:
                word.add(OTHER, str(at - DIGITS.start))
            elif at == NUKTA:
                word.dot()
            elif at in CONSONANTS:
                c = CONSONANTS[at]
                word.add(CONSONANT, (c[:-1] if len(c) > 1 and c.endswith("h") else c) + c if doubled else c)
                word.add(INHERENT, "a")
                doubled = False
            elif at in VOWELS:
                word.add(VOWEL, VOWELS[at])
            elif at in VOWEL_SIGNS:
                word.mute()
                word.add(VOWEL, VOWEL_SIGNS[at])
            elif at == VIRAMA:
                word.mute()
            elif at in STOPS:
                word = flush(STOPS[at])
            elif at in SIGNS:
                word.add(SIGN, SIGNS[at])
    flush("")
    return "".join(out)


@F.pandas_udf(StringType())
def to_latin(text: pd.Series, drop: pd.Series) -> pd.Series:
    """``transliterate`` of each text; a null text gives an empty one, a null ``drop`` means true."""
    return pd.Series([transliterate(t, True if d is None else bool(d)) for t, d in zip(text, drop)], dtype=object)
