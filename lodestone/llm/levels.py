"""Problem 8: the level at which a text is written, by readability formulas."""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.sources.tables import spread

#: Frequent short words by which a language is told. Fixed values.
FUNCTION_WORDS = {
    "en": "the and of to a in was for at on after by with is that",
    "de": "der die das und den dem am im von nach mit ein eine zu ist",
    "fr": "le la les et de du des un une à pour dans au avec est",
    "es": "el la los las y de del en un una para al con es por",
}
LEVELS = ("basic", "general", "expert")

#: Letters that are no part of a number, code, address or endless string.
_WORD = re.compile(r"(?<![\w@/+=|{}<>\\%])[^\W\d_]{1,44}(?![\w@/+=|{}<>\\%])")
_BETWEEN = re.compile(r"(?<=[.!?…])[\"'»”)\]]*\s+|\s{2,}|\s[-–—|•*]\s")
#: Words between two marks above which they are no sentence but text without marks, which is cut into pieces of PIECE words; and
#: words of a line up to which lines without marks are the items of a list, if there are at least ITEMS of them.
LONG, PIECE, ITEM, ITEMS = 100, 15, 3, 4
#: Letters that are vowels, and of each language those pairs and triples that are one sound. Fixed values.
_VOWEL = "aeiouyáàâäãåæéèêëíìîïóòôöõøœúùûüýÿ"
_ONE_SOUND = {
    "en": "ai au aw ay ea ee ei eu ew ey ie oa oe oi oo ou ow oy ue ui iou eau",
    "de": "aa ee oo ie ei ai au äu eu",
    "fr": "ai au ei eu œu oi ou eau eui oui ui ia ie iè io ieu",
    "es": "ai ei oi au eu ou ia ie io ua ue ui uo iá ié ió uá ué uí uó iu",
}
#: Further patterns: what ends without a sound of its own, and vowels that part or join against the rule. Fixed values.
_PATTERNS = {
    "en": "e3a. cre3a e2op ti5ali ci4a ti4a ti4o si4o ci4o gi4o xi4o i3a i3o e3o u3a y3i q2u u2a. gu2a",
    "de": "i3a i3o e3u. q2u",
    "fr": "i3é é3a é3o q2u2a q2u2e q2u2i g2u2e g2u2i u3é",
    "es": "q2u2e q2u2i g2u2e g2u2i",
}
_CONSONANTS = "bcdfghjklmnpqrstvwxzçñß"


def _hyphenation(lang: str) -> dict[str, list[int]]:
    """Hyphenation patterns: letters with the levels of the places before, between and behind them. An odd level lets a word be
    parted there, an even one forbids it, the highest of all patterns holds.

    A word can be parted before a consonant with a vowel behind it, and between vowels that aren't one sound; not before
    endings that are mute, and as the language's own patterns say.
    """
    made = [f"1{c}{v}" for c in _CONSONANTS for v in _VOWEL]
    made += [f"{a}1{b}" for a in _VOWEL for b in _VOWEL if f"{a}{b}" not in _ONE_SOUND[lang].split()]
    made += ["2".join(sound) for sound in _ONE_SOUND[lang].split()]
    if lang == "en":
        made += [f"2{c}{end}." for c in _CONSONANTS for end in ("e", "es", "ed")] + [f"{v}2{end}." for v in _VOWEL for end in ("e", "es", "ed")]
        made += [f"{c}3l{end}." for c in _CONSONANTS if c not in "lr" for end in ("e", "es", "ed")] + [f"3{c}es." for c in "szxcg"] + ["3shes.", "3ches.", "3ted.", "3ded."]
    elif lang == "fr":
        made += [f"2{c}{end}." for c in _CONSONANTS for end in ("e", "es", "ent")] + [f"{v}2{end}." for v in _VOWEL for end in ("e", "es", "ent")]
        made += [f"2{c}{d}{end}." for c in "bcdfgptv" for d in "lr" for end in ("e", "es", "ent")]
    out: dict[str, list[int]] = {}
    for pattern in [*made, *_PATTERNS[lang].split()]:
        letters, levels = "", [0]
        for c in pattern:
            if c.isdigit():
                levels[-1] = int(c)
            else:
                letters += c
                levels.append(0)
        out[letters] = [max(x, y) for x, y in zip(levels, out.get(letters, [0] * len(levels)), strict=True)]
    return out


_hyphens = {lang: _hyphenation(lang) for lang in FUNCTION_WORDS}
_longest = {lang: max(map(len, patterns)) for lang, patterns in _hyphens.items()}


def syllables(word: str, lang: str) -> int:
    """Syllables of a lower-case word: the parts into which the patterns part it behind its first vowel; at least 1."""
    marked, patterns, longest = f".{word}.", _hyphens[lang], _longest[lang]
    levels = [0] * (len(marked) + 1)
    for at in range(len(marked)):
        for size in range(1, min(longest, len(marked) - at) + 1):
            own = patterns.get(marked[at : at + size])
            if own:
                for k, level in enumerate(own):
                    if level > levels[at + k]:
                        levels[at + k] = level
    first = next((i for i, c in enumerate(marked) if c in _VOWEL), None)
    return 1 if first is None else 1 + sum(level % 2 for level in levels[first + 1 : len(marked) - 1])


def _grades(words: np.ndarray, letters: np.ndarray, beats: np.ndarray, long3: np.ndarray, long6: np.ndarray) -> np.ndarray:
    """Grades of each sentence by the classic formulas (formula, sentence); the coefficients are their published values."""
    syl, let = beats / words, letters / words
    return np.stack(
        [
            0.39 * words + 11.8 * syl - 15.59,  # Flesch-Kincaid
            0.4 * (words + 100 * long3 / words),  # Gunning fog
            1.043 * np.sqrt(30 * long3) + 3.1291,  # SMOG
            4.71 * let + 0.5 * words - 21.43,  # automated readability index
            5.88 * let - 29.6 / words - 15.8,  # Coleman-Liau
            (words + 100 * long6 / words - 10) / 4,  # LIX, on the scale of grades
        ]
    )


def _sentences(text: str) -> list[list[str]]:
    """Words of each sentence, of each item of a list, or of each piece of a text without marks."""
    out: list[list[str]] = []
    for stretch in _BETWEEN.split(text):
        words = _WORD.findall(stretch)
        if not words:
            continue
        if "\n" in stretch and len(words) > ITEM:
            lines = [w for line in stretch.split("\n") if (w := _WORD.findall(line))]
            if len(lines) >= ITEMS and 2 * sum(len(w) <= ITEM for w in lines) > len(lines):
                out += lines
                continue
        out += [words] if len(words) <= LONG else [words[i : i + PIECE] for i in range(0, len(words), PIECE)]
    return out


class _Words(dict):
    def __init__(self, lang: str):
        self.lang = lang

    def __missing__(self, word: str) -> tuple[int, int, int, int]:
        if len(self) > 200_000:
            self.clear()
        n = syllables(word, self.lang)
        self[word] = made = (len(word), n, int(n >= 3), int(len(word) > 6))
        return made


_known = {lang: _Words(lang) for lang in FUNCTION_WORDS}
_tell = {lang: frozenset(words.split()) for lang, words in FUNCTION_WORDS.items()}


def grade(text: str | None) -> tuple[str | None, float | None]:
    """Language by function words, and the grade; nulls for a text without words.

    A sentence's grade is the median of the formulas, a text's the median over its sentences, weighted by their words, so that
    a few sentences of another kind - an address, a price list, a quotation - don't move it.
    """
    sentences = _sentences(text.lower()) if text else []
    if not sentences:
        return None, None
    words = list(chain.from_iterable(sentences))
    counts = {lang: sum(map(own.__contains__, words)) for lang, own in _tell.items()}
    lang = max(counts, key=counts.__getitem__)
    sizes = np.fromiter(map(len, sentences), np.int64, len(sentences))
    each = np.fromiter(map(_known[lang].__getitem__, words), np.dtype((np.int64, 4)), len(words))
    sums = np.add.reduceat(each, np.cumsum(sizes) - sizes, axis=0)
    own = np.median(_grades(sizes.astype(float), *sums.T), axis=0)
    order = np.argsort(own, kind="stable")
    weight = np.cumsum(sizes[order])
    return lang, float(own[order[np.searchsorted(weight, weight[-1] / 2)]])


def graded(df: DataFrame, keep: tuple[str, ...]) -> DataFrame:
    """The columns ``keep``, ``written`` (language) and ``grade`` of column ``text``; nulls for a text without words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [grade(t) for t in batch.column(len(keep)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array([m[0] for m in made], pa.string()), pa.array([m[1] for m in made], pa.float64())], [*keep, "written", "grade"])

    source = spread(df.select(*keep, "text"))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields[:-1])
    return source.mapInArrow(run, f"{kinds}, written string, grade double")


def bounds(samples: DataFrame) -> DataFrame:
    """One row a language of labelled ``samples``: the grades between basic and general, and general and expert, halfway
    between the levels' medians. A language that lacks a level takes the medians over all languages."""
    marked = graded(samples.where("text is not null and level is not null").select("level", "text").coalesce(1), ("level",))
    medians = [F.percentile("grade", 0.5, F.when(F.col("level") == level, 1).otherwise(0)).alias(level) for level in LEVELS]
    own = {r["written"]: r for r in marked.groupBy("written").agg(*medians).collect()}  # a row a language
    every = marked.agg(*medians).first()
    rows = []
    for lang in FUNCTION_WORDS:
        basic, general, expert = (own[lang][n] if lang in own and own[lang][n] is not None else every[n] for n in LEVELS)
        rows.append((lang, None if None in (basic, general) else (basic + general) / 2, None if None in (general, expert) else (general + expert) / 2))
    return marked.sparkSession.createDataFrame(rows, "written string, from_general double, from_expert double")


def levels(documents: DataFrame, samples: DataFrame, least: int = 400) -> DataFrame:
    """``doc_id, written, grade, level`` of every document with ``n_chars`` of at least ``least``.

    Texts that are null or have no words, and rows with null ``n_chars``, have no level and no row; repeated rows stay.
    Without samples no bounds are known and no row comes out. The language is told from the text, not from ``lang``.
    """
    scored = graded(documents.where(F.col("n_chars") >= least).select("doc_id", "text"), ("doc_id",)).where("grade is not null")
    known = scored.join(F.broadcast(bounds(samples)), "written").where("from_expert is not null and from_general is not null")
    level = F.when(F.col("grade") < F.col("from_general"), LEVELS[0]).when(F.col("grade") < F.col("from_expert"), LEVELS[1]).otherwise(LEVELS[2])
    return known.select("doc_id", "written", "grade", level.alias("level"))
