"""Evidence for people's names and towns besides the lists of ``personal``: titles, salutations, labels, initials and common
given names in one text, and the family names, given names and towns that such contexts show anywhere in the corpus."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.sources.tables import cut, spread

#: Given names that are common and hardly anything else, a seed for texts that show no others; and particles. Fixed values.
COMMON_GIVEN = frozenset(
    "john james robert michael william david richard thomas charles daniel matthew anthony steven andrew kenneth kevin brian george edward ronald timothy jeffrey "
    "jacob nicholas jonathan stephen benjamin samuel gregory alexander patrick peter henry adam simon oliver harry "
    "mary maria patricia jennifer linda elizabeth barbara susan jessica sarah karen lisa nancy margaret sandra ashley kimberly emily donna michelle amanda laura helen sharon anna rachel emma olivia "
    "hans klaus wolfgang uwe dieter heinz helmut stefan andreas matthias sebastian tobias florian lukas karl ursula monika sabine renate brigitte claudia susanne julia "
    "pierre philippe alain nicolas laurent françois louis antoine julien nathalie isabelle sylvie monique jeanne "
    "josé antonio manuel francisco juan carlos miguel javier fernando pablo jorge alberto pedro maría isabel teresa ana cristina elena raquel "
    "paul mohammed ahmed fatima wei giovanni giuseppe marco luca paolo giulia ivan olga lars erik".split()
)
PARTICLE_WORDS = frozenset("von van der den de la del di da le du ter zu".split())
#: What stands before a person's name, in lower case. Fixed values.
TITLES = (
    "mr", "mr.", "mrs", "mrs.", "ms", "ms.", "miss", "dr", "dr.", "prof.", "professor", "sir", "herr", "herrn", "frau", "m.", "mme", "mme.", "monsieur", "madame", "mademoiselle",
    "señor", "señora", "sr.", "sra.", "don", "doña",
)
SALUTATIONS = ("dear", "hi", "hello", "lieber", "liebe", "hallo", "cher", "chère", "bonjour", "querido", "querida", "estimado", "estimada", "hola")
LABELS = (
    "name:", "full name:", "tenant:", "contact:", "attn:", "attention:", "patient:", "holder:", "signed:", "signed by", "regards,", "sincerely,", "faithfully,", "grüßen", "grüßen,", "mieter:", "mieterin:",
    "kunde:", "kundin:", "ansprechpartner:", "ansprechpartnerin:", "unterzeichnet:", "nom:", "nom :", "locataire:", "locataire :", "signé:", "signé :", "cordialement,", "nombre:", "inquilino:", "inquilina:", "firmado:", "atentamente,", "saludo,",
)
#: Capitalised words that are no part of a name, in texts that show no writing in lower case; and those that make a firm,
#: street or body of what stands before them. Fixed values.
OTHER = frozenset(
    "the a an and or of to in on at for by with from is was be has had have will would please thanks dear see call ask all no yes this that it he she we you they i my your our his her their if when "
    "der die das und oder von zu im am in auf für mit ist sind wird bitte danke wenn nach wir sie er es ich ihr le la les un une et ou de du des à au dans sur avec est nous vous il elle je merci "
    "el los las y o del al para con por es su gracias monday friday january march april may june july august sir madam damen herren team all customer member members colleague colleagues neighbour friend friends tenant "
    "kollegen kunde kunden mieter nachbarn collègues amigos vecinos".split()
)
FIRM = frozenset(
    "gmbh ag kg ltd ltd. limited inc inc. llc plc sa sarl group gruppe groupe grupo holding holdings logistics trust bank bakery clinic klinik joinery fils seguros board committee council department office company partners "
    "services solutions systems insurance university hospital school church club street road lane avenue drive square place court terrace close hill row way house park station hotel centre center foundation society association".split()
)

#: Ends of German street names, which are written as one word. Fixed values.
STREET_ENDS = ("straße", "strasse", "str", "allee", "weg", "gasse", "platz")

B = r"(?:[ \t\xa0]|[ \t\xa0]?\r?\n[ \t\xa0]?|\r)"
_UPPER = "A-ZÀ-ÖØ-ÞĀĂĄĆČĎĐĒĘĚĞĢĪĮİĶĹĻĽŁŃŅŇŌŐŒŔŘŚŞŠŢŤŪŮŰŲŹŻŽ"
CAPITAL = rf"[{_UPPER}][^\W\d_]*(?:['’-][^\W\d_]+)*"
_TOKEN = re.compile(rf"(?:[^\W\d_]\.(?=[ \t\xa0\r\n]|[{_UPPER}])|[^\W\d_]+(?:['’-][^\W\d_]+)*)(?![\w@])")
_GAP = re.compile(r"[ \t\xa0]{1,2}(?![\r\n])|[ \t\xa0]?\r?\n[ \t\xa0]?|\r")
_BACK = re.compile(rf"(?:^|(?<![\w'’@.+-]))([^\W\d_]\.|[^\W\d_]+(?:['’-][^\W\d_]+)*)(?:[ \t\xa0]{{1,2}}|[ \t\xa0]?\r?\n[ \t\xa0]?|\r|(?<=\.))$")
_LAST = re.compile(r"[^\s.]+\Z")
_COMMA = re.compile(rf",{B}{{0,2}}")
_ENDS = re.compile(r"[ \t\xa0]*(?:[,.;:)|\n\r]|$)")
_POST_UK = r"[A-Z]{1,2}\d{1,2}[A-Z]?[ \xa0]\d[A-Z]{2}(?!\w)"
_JOIN = r"(?:(?:[ \xa0](?:am|an der|an|im|in der|sur|sous|upon|on|le|la|les|de la|de|del|by|auf)[ \xa0]|[- \xa0])" + CAPITAL + ")"
_no_town = "|".join(sorted((w for w in OTHER if w not in ("la", "le", "les", "el", "los", "las")), key=len, reverse=True))
#: One to three words of a town.
TOWN = rf"(?!(?i:{_no_town})(?!\w))(?:St\.?[ \xa0])?{CAPITAL}{_JOIN}{{0,2}}"
#: A town after a postcode: further words of it need a joining word or hyphen.
TOWN_AFTER = rf"(?!(?i:{_no_town})(?!\w)){CAPITAL}(?:(?:[ \xa0](?:am|an der|an|im|in der|sur|sous|upon|on|le|la|les|de la|de|del|by|auf)[ \xa0]|-){CAPITAL}){{0,2}}(?!\w)"
_TOWNED = re.compile(rf",\s(?:({TOWN}),?[ \xa0](?:{_POST_UK}|[A-Z]{{2}}[ \xa0]\d{{5}}(?!\d)|\d{{5}}(?!\d))|\d{{5}}[ \xa0]({TOWN_AFTER}))")
_POST = re.compile(rf",?{B}{{1,2}}(?:(?:[a-z]{{2}}{B})?\d{{5}}(?:-\d{{4}})?|[a-z]{{1,2}}\d{{1,2}}[a-z]?{B}\d[a-z]{{2}})(?!\w)", re.IGNORECASE)
_TOWN_WORDS = re.compile(rf",?{B}{{1,2}}([^\W\d_]+(?:['’-][^\W\d_]+)*(?:{B}[^\W\d_]+(?:['’-][^\W\d_]+)*){{0,4}})")
_LAST_WORD = re.compile(r"[^\W\d_]+(?:['’-][^\W\d_]+)*\Z")
_SPACES = re.compile(r"[\s\xa0]+")
_NAME_PART = r"[^\W\d_]+"
_WHOLE_LEFT, _WHOLE_RIGHT = re.compile(rf"(?:{_NAME_PART}['’-])*(?:{_NAME_PART})?\Z"), re.compile(rf"(?:{_NAME_PART})?(?:['’-]{_NAME_PART})*")
#: Capitalised words and initials side by side in one line, with particles between; the words of one; the word before it.
_SIDE = rf"(?:[{_UPPER}][^\W\d_]*(?:['’-][^\W\d_]+)*|[{_UPPER}]\.)"
_RUN = re.compile(rf"(?<![\w'’@.+-]){_SIDE}(?:[ \xa0]{{1,2}}(?:(?:{'|'.join(sorted(PARTICLE_WORDS))})[ \xa0]){{0,2}}{_SIDE})+(?![\w@])")
_SIDES = re.compile(_SIDE)
_TURNED = re.compile(rf"({CAPITAL}),[ \xa0\n]({CAPITAL})(?![\w@])")
_WORD_BEFORE = re.compile(r"([^\W\d_]+)[.:,]?[ \t\xa0\r\n]{0,3}\Z")


def lowered(text: str) -> str:
    """Lower case, character by character, so that places stay the same."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(c.lower() if len(c.lower()) == 1 else c for c in text)


def _contexts() -> ahocorasick.Automaton:
    made = ahocorasick.Automaton()
    for words, kind in ((TITLES, "title"), (SALUTATIONS, "title"), (LABELS, "label")):
        for word in words:
            made.add_word(word, (len(word), kind))
    for word in COMMON_GIVEN:
        made.add_word(word, (len(word), "given"))
    made.make_automaton()
    return made


_before = _contexts()
_TITLE_WORDS = frozenset(t.rstrip(".") for t in TITLES if t != "m.")


class Lexicon:
    """Family names, given names, towns and kinds of firms: what the corpus shows (``learned``), and the common given names."""

    def __init__(self, family: frozenset[str] = frozenset(), given: frozenset[str] = frozenset(), towns: frozenset[str] = frozenset(), kinds: frozenset[str] = frozenset()):
        self.family, self.given, self.towns, self.kinds = family, COMMON_GIVEN | given, towns, kinds
        self.anchors = ahocorasick.Automaton()
        self.anchors.add_word("\0", (1, False, False))  # an automaton needs a key
        for word in self.family | given:
            self.anchors.add_word(word, (len(word), word in self.family, word in given))
        self.anchors.make_automaton()

    def is_family(self, low: str) -> bool:
        """Whether ``low`` is a known family name, one behind O' or D', or several with hyphens."""
        if low in self.family:
            return True
        if low[:2] in ("o'", "o’", "d'", "d’"):
            return self.is_family(low[2:])
        return "-" in low and all(map(self.is_family, low.split("-")))

    def _is_given(self, token: str) -> bool:
        low = token.lower()
        return low in self.given or (len(token) == 2 and token[1] == "." and token[0].isupper()) or ("-" in low and all(p in self.given for p in low.split("-")))

    def _family_at(self, text: str, at: int, known: bool) -> int | None:
        """End of a family name at ``at``, with particles before it, and of a second family name that is known."""
        end, particles = at, 0
        while (m := _TOKEN.match(text, end)) is not None:
            word = m[0]
            low = word.lower()
            if low in PARTICLE_WORDS and particles < 3 and (particles or low not in ("der", "den", "ter", "zu")) and (gap := _GAP.match(text, m.end())):
                end, particles = gap.end(), particles + 1
                continue
            if word.endswith(".") or len(word) < 2 or not word[0].isupper() or low in OTHER or low in FIRM or low in CUES or (known and not self.is_family(low)):
                return None
            end = m.end()
            while (gap := _GAP.match(text, end)) is not None and (m := _TOKEN.match(text, gap.end())) is not None:
                low = m[0].lower()
                if low in FIRM:
                    return None
                if not (m[0][0].isupper() and self.is_family(low) and "\n" not in gap[0]):
                    break
                if (gap := _GAP.match(text, m.end())) is not None and (after := _TOKEN.match(text, gap.end())) is not None and after[0][0].isupper() and "\n" not in gap[0]:
                    break  # capitals go on: more than a second family name
                end = m.end()
            return end
        return None

    def forward(self, text: str, at: int, strong: bool, known: bool = False) -> tuple[int, int] | None:
        """A name that begins at ``at``: given names or initials, then a family name (``known``: one that the corpus shows). After
        a title or label (``strong``) the first of two capitalised words counts as a given name."""
        while strong and (m := _TOKEN.match(text, at)) is not None and m[0].lower() in _TITLE_WORDS and (gap := re.compile(rf"\.?(?:{_GAP.pattern})").match(text, m.end())):
            at = gap.end()
        end, given, last = at, 0, None
        while given < 4 and (m := _TOKEN.match(text, end)) is not None:
            word = m[0]
            low = word.lower()
            new = strong and not given and word[0].isupper() and len(word) > 1 and word[-1] != "." and low not in OTHER and low not in FIRM and not self.is_family(low) and low not in PARTICLE_WORDS
            if not (word[0].isupper() and self._is_given(word) or new):
                break
            gap = _GAP.match(text, m.end()) or (word.endswith(".") and _TOKEN.match(text, m.end()))
            last = (m.end(), low)
            given += 1
            if not gap:
                end = -1
                break
            end = gap.end() if gap.re is _GAP else m.end()
        if not given:
            return None
        stop = self._family_at(text, end, known) if end >= 0 else None
        if stop is None:
            return (at, last[0]) if given > 1 and self.is_family(last[1]) else None
        if not strong and text[at : at + 2].isupper() and not _ENDS.match(text, stop):
            return None  # words in capitals go on
        if strong and (gap := _GAP.match(text, stop)) and (more := _TOKEN.match(text, gap.end())) and "\n" not in gap[0]:
            low = more[0].lower()
            if more[0][0].isupper() and len(more[0]) > 1 and text[stop - len(_LAST.search(text, at, stop)[0]) : stop].lower() not in self.family and low not in OTHER and low not in FIRM and not low.endswith(STREET_ENDS) and not self._is_given(text[at : _TOKEN.match(text, at).end()]) and _ENDS.match(text, more.end()):
                stop = more.end()
        return at, stop

    def around(self, text: str, start: int, end: int) -> tuple[int, int] | None:
        """A name whose family name, a known one, stands at ``start`` to ``end``."""
        first, ok, at = start, False, start
        for _ in range(6):
            m = _BACK.search(text, max(0, at - 30), at)
            if not m or (m.start() == max(0, at - 30) and at > 30 and m.start() and text[m.start() - 1].isalnum()):
                break
            word = m[1]
            if self._is_given(word) and (word[0].isupper() or word.lower() in self.given):
                first, ok, at = m.start(1), True, m.start(1)
            elif not ok and word.lower() in PARTICLE_WORDS:
                at = m.start(1)
            else:
                break
        if ok and (text[start].isupper() or text[first].islower()):
            stop = self._family_at(text, start, False) if text[start].isupper() else end
            return (first, stop) if stop else None
        if text[start].isupper():
            end = self._family_at(text, start, True) or end
        comma = _COMMA.match(text, end)
        if comma and (m := _TOKEN.match(text, comma.end())) and self._is_given(m[0]) and (m[0][0].isupper() or text[start].islower()) and (m[0].lower() in self.given or m[0].endswith(".") and _ENDS.match(text, m.end())):
            stop = m.end()
            while (gap := _GAP.match(text, stop)) and (m := _TOKEN.match(text, gap.end())) and self._is_given(m[0]) and m[0][0].isupper() == text[start].isupper():
                stop = m.end()
            return self._particles(text, start), stop
        return None

    def _particles(self, text: str, start: int) -> int:
        """Where a family name at ``start`` begins with its particles. Behind a number or "nombre" the first "de" is a preposition."""
        at, places = start, []
        while len(places) < 3 and (m := _BACK.search(text, max(0, at - 12), at)) is not None and m[1].lower() in PARTICLE_WORDS:
            at = m.start(1)
            places.append((at, m[1].lower()))
        if places and places[-1][1] in ("de", "del", "du", "d'") and re.search(r"(?:\d\w{0,3}|-\w|nombre)[\s\xa0]{1,3}\Z", text[max(0, at - 12) : at]):
            places.pop()
        return places[-1][0] if places else start

    def names(self, text: str, low: str) -> Iterator[tuple[int, int, str]]:
        """Names by evidence: start, end and what showed them (``title``, ``label``, ``given``, ``family``)."""
        for at, (length, kind) in _before.iter(low):
            start, end = at - length + 1, at + 1
            if start and (low[start - 1].isalnum() or low[start - 1] in "'’-@._+"):
                continue
            if kind == "given":
                if text[start].isupper() and not (end < len(low) and (low[end].isalnum() or low[end] in "@'’_")) and (span := self.forward(text, start, False)):
                    yield *span, kind
            elif (gap := _GAP.match(text, end)) is not None and (kind == "label" or "\n" not in gap[0]):
                if span := self.forward(text, gap.end(), True):
                    yield *span, kind
        done = -1
        for at, (length, family, given) in self.anchors.iter(low):
            start, end = at - length + 1, at + 1
            if (start and (low[start - 1].isalnum() or low[start - 1] in "@+._")) or (end < len(low) and (low[end].isalnum() or low[end] in "@_")):
                continue
            if family and end > done:
                if (start and low[start - 1] in "-'’") or (end < len(low) and low[end] in "-'’"):  # a part of a longer name
                    start -= len(_WHOLE_LEFT.search(low, max(0, start - 60), start)[0])
                    end = _WHOLE_RIGHT.match(low, end).end()
                    if (start and low[start - 1] in "@+._-") or (end < len(low) and low[end] in "@_") or not self.is_family(low[start:end]):
                        continue
                if span := self.around(text, start, end):
                    done = span[1]
                    yield *span, "family"
            if given and text[start].isupper() and (span := self.forward(text, start, False, True)):
                yield *span, "given"

    def place(self, text: str, at: int) -> int:
        """``at``, or the end of a known town and a postcode that follow there, in either order."""
        seen: set[str] = set()
        if (last := _LAST_WORD.search(text, max(0, at - 40), at)) and (m := _TOWN_WORDS.match(f" {text[last.start() : at + 80]}")):  # a town begun with its first word
            ends = [x.end() for x in re.finditer(r"[^\s\xa0]+", m[1])]
            known = [e for e in reversed(ends) if e > at - last.start() and _SPACES.sub(" ", m[1][:e]).lower() in self.towns]
            if known:
                at = last.start() + known[0]
        while at < len(text) and len(seen) < 2:
            if "post" not in seen and ("town" in seen or text[at] == ",") and (m := _POST.match(text, at)):
                seen.add("post")
                at = m.end()
                continue
            m = _TOWN_WORDS.match(text, at) if self.towns and "town" not in seen else None
            ends = [len(m[1]), *(x.start() for x in reversed([*_SPACES.finditer(m[1])]))] if m else []
            known = [end for end in ends if _SPACES.sub(" ", m[1][:end]).lower() in self.towns]
            if not known:
                break
            seen.add("town")
            at = m.start(1) + known[0]
        return at


def gather(text: str, counts: Counter, words: Counter) -> None:
    """Adds what ``text`` shows: capitalised words side by side, or the other way round with a comma (``pair``), such behind a title, salutation or label
    (``strong``), towns beside postcodes, and all words as they are written."""
    for m in _RUN.finditer(text):
        sides = _SIDES.findall(m[0])
        if all(x.isupper() for x in sides if len(x) > 2):
            continue
        before = _WORD_BEFORE.search(text, max(0, m.start() - 24), m.start())
        strong, first = before is not None and before[1].lower() in CUES, 0
        while first < len(sides) - 1 and sides[first].lower().rstrip(".") in CUES:
            strong, first = True, first + 1
        if strong and len(sides) - first > 1:
            counts["strong", sides[first].lower(), (sides[-1] if len(sides) - first < 4 else sides[first + 1]).lower()] += 1
        for a, b in zip(sides, sides[1:], strict=False):
            counts["pair", a.lower(), b.lower()] += 1
    for m in _TURNED.finditer(text):
        counts["pair", m[2].lower(), m[1].lower()] += 1
    for m in _TOWNED.finditer(text):
        counts["town", (m[1] or m[2]).lower(), ""] += 1
    words.update(text.split())


#: Titles, salutations and labels as single words.
CUES = frozenset(w.rstrip(".:, ") for w in (*TITLES, *SALUTATIONS, *LABELS))
_EDGES = re.compile(r"\A[\W\d_]+|[\W\d_]+\Z")


_WORD = re.compile(r"[^\W\d_]+(?:-[^\W\d_]+)*")


def evidence(chunks: DataFrame, words_where: Column | None = None) -> DataFrame:
    """``what, a, b, n``: counts over all texts, by ``gather``; words as ``small`` (in lower case) and ``large`` (capitalised).

    ``words_where``: also counts, as ``word``, all words in lower case and the parts of those with hyphens in the rows for which
    it holds; the empty word holds the number of all. Texts are split at blanks; what a word is is looked at only once for each
    different string."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[tuple[str, str, str]] = Counter()
        words: tuple[Counter[str], Counter[str]] = (Counter(), Counter())

        def rows() -> pa.RecordBatch:
            for vocabulary, own in enumerate(words):
                for word, n in own.items():
                    bare = _EDGES.sub("", word)
                    if len(bare) > 1 and (bare.islower() or (bare[0].isupper() and not bare.isupper())):
                        counts["small" if bare.islower() else "large", bare.lower(), ""] += n
                    for w in _WORD.findall(word) if vocabulary else ():
                        counts["word", "", ""] += n
                        for part in (w, *w.split("-")) if "-" in w else (w,):
                            counts["word", part.lower(), ""] += n
            keys = list(counts)
            return pa.RecordBatch.from_arrays([*[pa.array([k[i] for k in keys], pa.string()) for i in range(3)], pa.array(list(counts.values()), pa.int64())], ["what", "a", "b", "n"])

        for batch in batches:
            for text, counted in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                gather(text, counts, words[bool(counted)])
            if len(counts) + sum(map(len, words)) > 500_000:
                yield rows()
                for c in (counts, *words):
                    c.clear()
        yield rows()

    texts = spread(chunks.where("text is not null").select("text", (F.lit(False) if words_where is None else words_where).alias("counted")))
    return texts.mapInArrow(run, "what string, a string, b string, n long").groupBy("what", "a", "b").agg(F.sum("n").alias("n"))


#: Family names behind titles and labels that a given name needs, and the share of a word's capitalised places at which a
#: family name must stand behind a given name, initial or title; family names before a kind of firm,
#: and the share of its capitalised places at which it must stand behind such a name or kind.
DIVERSE, SHARE, NAMED, NAMED_SHARE = 2, 0.1, 5, 0.3


def learned(chunks: DataFrame) -> dict[str, frozenset[str]]:
    """What all texts of ``chunks`` together show."""
    return shown(cut(evidence(chunks)))


def shown(counts: DataFrame) -> dict[str, frozenset[str]]:
    """``family``, ``given``, ``towns`` and ``kinds``: the words that all texts together show to be such.

    A given name stands behind titles, salutations or labels before ``DIVERSE`` different words that are hardly ever written
    in lower case. A family name is such a word that stands behind given names or initials, not much rarer than in lower case and
    at ``SHARE`` of its capitalised places at least. A town stands beside postcodes more often than in lower case and at ``SHARE`` of its capitalised places. A
    kind of firm (or a word before it) stands behind ``NAMED`` different family names or behind such a word, and at ``NAMED_SHARE`` of its capitalised places. They are collected, as all tasks look them up: as many as the corpus has different names (1,100 on sf0.1).
    """
    of = lambda what: counts.where(F.col("what") == what)
    small, large = (of(what).select(F.col("a").alias("word"), F.col("n").alias(what)) for what in ("small", "large"))
    strong = of("strong").select("a", F.col("b").alias("word"), "n").join(small, "word", "left").where(F.coalesce("small", F.lit(0)) <= F.col("n"))
    given = strong.groupBy("a").agg(F.count(F.lit(1)).alias("ends")).where((F.length("a") > 2) & (F.col("ends") >= F.when(F.col("a").isin(*OTHER), 2 * DIVERSE).otherwise(DIVERSE)))
    given = cut(given.where(~F.col("a").isin(*(CUES | FIRM | PARTICLE_WORDS))).select("a"))
    given = given.unionByName(given.sparkSession.createDataFrame([(n,) for n in sorted(COMMON_GIVEN)], "a string")).distinct()
    initial = (F.length("a") == 2) & F.col("a").endswith(".")
    behind = of("pair").join(given.withColumn("known", F.lit(True)), "a", "left").where(F.col("known") | initial).select(F.col("b").alias("word"), "n").unionByName(strong.select("word", "n"))
    behind = behind.join(given.select(F.col("a").alias("word")), "word", "left_anti")
    behind = behind.unionByName(behind.where("word like '%-%'").select(F.explode(F.split("word", "-")).alias("word"), "n"))  # of double names each
    family = behind.groupBy("word").agg(F.sum("n").alias("n")).where((F.length("word") > 2) & ~F.col("word").isin(*(OTHER | FIRM | CUES | PARTICLE_WORDS)))
    family = family.join(small, "word", "left").join(large, "word", "left").where((4 * F.col("n") > F.coalesce("small", F.lit(0))) & (F.col("n") >= SHARE * F.coalesce("large", F.lit(0))) & ~F.col("word").rlike(f"(?:{'|'.join(STREET_ENDS)})$"))
    family = cut(family.join(given.select(F.col("a").alias("word")), "word", "left_anti").select("word"))
    named = of("pair").join(family.select(F.col("word").alias("a")), "a", "left_semi").join(given.select(F.col("a").alias("b")), "b", "left_anti").join(family.select(F.col("word").alias("b")), "b", "left_anti")
    often = lambda df: df.join(large, df["b"] == large["word"], "left").where((F.col("n") >= NAMED_SHARE * F.coalesce("large", F.lit(0))) & (F.length("b") > 1) & ~F.col("b").isin(*(OTHER | CUES | PARTICLE_WORDS)) & ~F.col("b").rlike(f"(?:{'|'.join(STREET_ENDS)})$")).select("b")
    kinds = often(named.groupBy("b").agg(F.count(F.lit(1)).alias("names"), F.sum("n").alias("n")).where(F.col("names") >= NAMED))
    behind = often(of("pair").join(kinds.select(F.col("b").alias("a")), "a", "left_semi").groupBy("b").agg(F.sum("n").alias("n")).where(F.col("n") >= NAMED))
    kinds = kinds.unionByName(behind).distinct()
    towns = of("town").select(F.col("a").alias("word"), "n").join(small, "word", "left").join(large, "word", "left")
    towns = towns.where((F.col("n") > F.coalesce("small", F.lit(0))) & (F.col("n") >= SHARE * F.coalesce("large", F.lit(0))))
    take = lambda df, c: frozenset(r[0] for r in df.select(c).collect())
    return {"family": take(family, "word"), "given": take(given, "a"), "towns": take(towns, "word"), "kinds": take(kinds, "b")}
