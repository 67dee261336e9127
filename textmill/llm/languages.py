"""Which language a text is written in.

Scripts tell most languages apart. Languages that share the Latin script are
compared by profiles: counts of words and of runs of two to four letters, fitted
on a bounded sample of labelled texts and scored as in naive Bayes. Texts whose
label the first profile contradicts are left out of the second, so wrong labels
in the sample do little.

A profile only knows the languages it was fitted on. ``differ`` therefore asks
for two things: each text is clearly better explained by its own language than
by the other's, and one of them has enough known words to be trusted. A text in
a language without a profile still differs from one in a language that has one,
and two texts in unknown languages never do.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The sample: texts a language, and the longest text that may be in it.
SAMPLE_TEXTS, SAMPLE_CHARS = 300, 4000
#: Natural logarithms by which a language must be ahead, in all and for each word; share of known words to be trusted.
AHEAD, AHEAD_A_WORD, TRUSTED = 5.0, 0.3, 0.45
#: Words a text needs.
LEAST_WORDS = 3

# Code points of scripts.
HAN, KANA, CYRILLIC = re.compile("[㐀-䶿一-鿿]"), re.compile("[぀-ヿ]"), re.compile("[Ѐ-ӿ]")
OTHER_SCRIPTS = {"th": re.compile("[฀-๿]"), "hi": re.compile("[ऀ-ॿ]"), "ar": re.compile("[؀-ۿ]"), "ko": re.compile("[가-힯]"), "el": re.compile("[Ͱ-Ͽ]"), "he": re.compile("[֐-׿]")}
_LATIN_LETTER = re.compile("[a-zà-öø-ÿœßA-ZÀ-ÖØ-ÞŒẞĀ-ɏ]")
#: Words of the Latin script, and the marks that open a sentence in one language only. File names, run names and words with digits belong to no language.
LATIN = re.compile(r"(?<![\w.\-])[a-zà-öø-ÿœßā-ɏ]+(?!\w|[-_.]\w)|[¿¡]")
QUOTED = re.compile(r"\"[^\"]*\"|“[^”]*”|„[^“”]*[“”]|«[^»]*»|「[^」]*」|『[^』]*』|```.*?(?:```|$)|`[^`]*`", re.S)


def script(text: str) -> str | None:
    """``latin``, or the language that a script stands for; null if too short."""
    if text.isascii() or max(text, default="") < "\u0250":
        return "latin" if _LATIN_LETTER.search(text) else None
    latin = len(_LATIN_LETTER.findall(text))
    for lang, letters in OTHER_SCRIPTS.items():
        n = len(letters.findall(text))
        if n >= 3 and n > latin:
            return lang
    kana, han, cyrillic = len(KANA.findall(text)), len(HAN.findall(text)), len(CYRILLIC.findall(text))
    if kana + han >= 2 and (kana + han) * 3 >= latin:
        return "ja" if kana and kana * 8 >= han else "zh"
    if cyrillic >= 3 and cyrillic >= latin:
        return "ru"
    return "latin" if latin else None


def latin_words(text: str) -> list[str]:
    return LATIN.findall(text.lower())


def _features(word: str) -> list[str]:
    padded = f" {word} "
    return ["=" + word] + [padded[i : i + n] for n in (2, 3, 4) for i in range(len(padded) - n + 1)]


@dataclass
class Profiles:
    """Log probabilities of features under each language."""

    langs: list[str] = field(default_factory=list)
    table: dict[str, list[float]] = field(default_factory=dict)
    none: list[float] = field(default_factory=list)
    words: list[Counter] = field(default_factory=list)
    _seen: dict[str, list[float]] = field(default_factory=dict, repr=False, compare=False)

    @classmethod
    def fit(cls, rows: list[tuple[str, str]]) -> Profiles:
        """Profiles of (language, text) rows, fitted twice."""
        first = cls._count(rows)
        kept = [(lang, t) for lang, t in rows if (best := first.best(latin_words(t))) is None or best == lang]
        return cls._count(kept)

    @classmethod
    def _count(cls, rows: list[tuple[str, str]]) -> Profiles:
        langs = sorted({lang for lang, _ in rows})
        counts, words = {k: Counter() for k in langs}, {k: Counter() for k in langs}
        for lang, text in rows:
            words[lang].update(latin_words(text))
        for lang in langs:
            for w, n in words[lang].items():
                # the root keeps the many repetitions of a few words from drowning the rest
                for f in _features(w):
                    counts[lang][f] += math.sqrt(n)
        features = set().union(*counts.values()) if langs else set()
        totals = {k: sum(counts[k].values()) + 0.2 * len(features) for k in langs}
        table = {f: [math.log((counts[k][f] + 0.2) / totals[k]) for k in langs] for f in features}
        return cls(langs, table, [0.0] * len(langs), [words[k] for k in langs])

    def _word(self, w: str) -> list[float]:
        got = self._seen.get(w)
        if got is None:
            if len(self._seen) > 100_000:
                self._seen.clear()
            rows = [r for f in _features(w) if (r := self.table.get(f)) is not None]
            # overlapping features say the same thing several times
            got = self._seen[w] = [sum(c) / 3 for c in zip(*rows)] if rows else self.none
        return got

    def scores(self, words: list[str]) -> list[float]:
        return list(map(sum, zip(*map(self._word, words)))) if words else list(self.none)

    def best(self, words: list[str]) -> str | None:
        if not self.langs or not words:
            return None
        s = self.scores(words)
        return self.langs[max(range(len(s)), key=s.__getitem__)]

    def known(self, lang: str, words: list[str]) -> float:
        """Share of words that the sample of a language has."""
        have = self.words[self.langs.index(lang)]
        return sum(w in have for w in words) / max(1, len(words))

    def cut_word(self, word: str, lang: str | None) -> bool:
        """The language doesn't know the word, but one that begins with it is frequent."""
        if lang not in self.langs:
            return False
        have = self.words[self.langs.index(lang)]
        return word not in have and any(n >= 5 and w.startswith(word) for w, n in have.items())


_MARKED = re.compile("[\"“„«「『`]")


def _bare(text: str) -> str:
    """The text without quotations, unless they are all there is."""
    if not _MARKED.search(text):
        return text
    bare = QUOTED.sub(" ", text)
    enough = len(latin_words(bare)) >= LEAST_WORDS or (script(bare) or "latin") != "latin"
    return bare if enough else text.translate(_UNQUOTED)


_UNQUOTED = str.maketrans({c: " " for c in "\"“”„«»「」『』`"})


class Reading:
    """What a text shows of its language."""

    def __init__(self, text: str, profiles: Profiles):
        bare = _bare(text)
        self.script, self.words, self.lang = script(bare), [], None
        if self.script == "latin":
            every = latin_words(bare)
            self.words = list(dict.fromkeys(every))
            if len(every) >= LEAST_WORDS:
                self.lang = profiles.best(self.words)
        else:
            self.lang = self.script


def _ahead(r: Reading, over: str, profiles: Profiles) -> bool:
    s = profiles.scores(r.words)
    lead = s[profiles.langs.index(r.lang)] - s[profiles.langs.index(over)]
    return lead >= AHEAD + AHEAD_A_WORD * len(r.words)


def differ(want: Reading, got: Reading, profiles: Profiles) -> bool:
    """The two texts are in different languages, beyond doubt."""
    if want.lang is None or got.lang is None or want.lang == got.lang:
        return False
    if want.script != "latin" or got.script != "latin":
        return True
    trusted = profiles.known(want.lang, want.words) >= TRUSTED or profiles.known(got.lang, got.words) >= TRUSTED
    return trusted and _ahead(want, got.lang, profiles) and _ahead(got, want.lang, profiles)


def is_not(lang: str, got: Reading, profiles: Profiles) -> bool:
    """The text is not in the language that was asked for."""
    if got.lang is None or got.lang == lang:
        return False
    if got.script != "latin" or lang not in profiles.langs:
        return got.script != "latin" or lang in ("ru", "zh", "ja", "th", "hi", "ar", "ko")
    return _ahead(got, lang, profiles)


def fit_profiles(documents: DataFrame, text: str = "text", lang: str = "lang", per_language: int = SAMPLE_TEXTS, longest: int = SAMPLE_CHARS) -> Profiles:
    """Profiles of the Latin-script languages of a labelled table.

    The sample has about ``per_language`` texts of each label (case and
    regional parts aside), chosen by a hash of the text, none longer than
    ``longest`` characters; so what reaches the driver is bounded whatever the
    table holds. Null labels and texts take no part; an empty table gives
    profiles that know no language.
    """
    rows = documents.select(F.lower(F.regexp_extract(F.trim(lang), "^([A-Za-z]{2,3})(?:[-_].*)?$", 1)).alias("lang"), F.col(text).alias("text"))
    usable = rows.where((F.col("lang") != "") & F.col("lang").isNotNull() & (F.length("text").between(40, longest)))
    counts = {r["lang"]: r["n"] for r in usable.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "lang").limit(64).collect()}
    if not counts:
        return Profiles()
    place = (F.xxhash64("text").bitwiseAND(F.lit((1 << 53) - 1))) / float(1 << 53)
    share = F.element_at(F.create_map(*[F.lit(x) for k, n in counts.items() for x in (k, min(1.0, per_language / n))]), F.col("lang"))
    sample = usable.where(F.col("lang").isin(list(counts)) & (place < share)).limit(2 * per_language * len(counts)).collect()
    texts = sorted({(r["lang"], r["text"]) for r in sample})
    held = Counter(k for k, _ in texts)
    return Profiles.fit([(k, QUOTED.sub(" ", t)) for k, t in texts if script(t) == "latin" and held[k] >= 5 and k != "und"])
