"""Problem 5: scanner damage and page furniture in texts of scanned pages.

Lines of furniture are told by their form and neighbours. The rest is one stream of characters without lines: words broken
at line ends are put together again, and the stream is decoded against a trie of the corpus's own vocabulary as the cheapest
sequence of words under added and dropped blanks, hyphens and confused characters. Paragraphs are then chosen over all line ends at once by least cost.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.names import Lexicon, evidence, lowered, shown
from lodestone.sources.tables import cut, spread

#: What scanners make of characters: as read, and as meant. Fixed values.
CONFUSED = (
    ("c", "e"), ("0", "o"), ("@", "a"), ("¦", "r"), ("1", "i"), ("1", "l"), ("~", "t"), ("ri", "n"), ("cl", "d"), ("5", "s"), ("ii", "u"), ("ii", "ü"),
    ("(", "c"), ("q", "g"), ("b", "h"), ("rn", "m"), ("f", "e"), ("ü", "ti"), ("6", "b"), ("6", "ó"), ("6", "é"), ("vv", "w"), ("rm", "nn"), ("8", "b"), ("9", "g"), ("|", "l"), ("ni", "m"), ("!", "l"), ("ﬁ", "fi"),
)
#: A word is in the vocabulary if it has at least this share of the words of texts without pages, and stands there twice; so
#: there are at most 1 / SHARE words of it, whatever the size of the corpus.
SHARE = 2e-6

#: Costs of a reading: a confusion, a blank or hyphen added within a word, one at a line end, a blank dropped, a word of one or
#: of two letters beside a dropped blank, and a word that stays unknown, of up to four letters too. Words of one letter are
#: only these.
CONFUSION, ADDED, ADDED_LINE, DROPPED, ONE, TWO, UNKNOWN, UNKNOWN_SHORT = 1.0, 1.5, 1.6, 1.5, 0.75, 0.5, 3.2, 2.4
SINGLE = frozenset("aiyoeuàó")
#: Known words on each side of an unknown one that its reading can take in: more blanks cost more than it.
AROUND = int(UNKNOWN / ADDED)

_LINE = re.compile(r"\r\n|\n|\r")
_RUN = re.compile(r"[\w@¦~|]*[^\W\d_][\w@¦~|]*(?:\([\w@¦~|]*[^\W\d_][\w@¦~|]*)*|\([\w@¦~]*[^\W\d_][\w@¦~]*")
_PARTS = re.compile(r"[^ \n-]+")
_MARK = re.compile(r"([^\W\d_][\w@¦~(]*|[@¦~])([-‐¬­])[ \t]*$")
_MAIL = re.compile(r"\S+\s?(?:@|[(\[]at[)\]])\s?\S+[.]\w{2,}|\w+@\w+[.]\w+", re.IGNORECASE)
_D = r"[0-9lIOo|S]"
#: The mark of a file or edition in a header.
_CODE = r"\d{1,4}/[A-Z]{1,3}"
_PAGE = re.compile(
    rf"(?:[—–-] ?{_D}{{1,5}} ?[—–-]|[\[(]{_D}{{1,5}}[\])]|(?:[Pp][a@][gq][ec]|[Pp][gq]\.?|[Pp]\.|[Ss][ec][i1l][t~][ec]|S\.|[Pp]ágina) ?{_D}{{1,5}}(?: ?(?:[o0][f]|von|sur|d[ec]|/) ?{_D}{{1,5}})?|{_D}{{1,5}} ?/ ?{_D}{{1,5}}|[0-9]{_D}{{0,4}}|{_D}{{0,4}}[0-9]|l{{1,3}}|l[OoS]|[ivxlc]{{1,8}})"
)
_UPPER = re.compile(rf"[^\Wa-zß_][^\Wa-zäöüéèàùçñóíáúêâîôûëï_@¦~(]*(?:[ -][^\Wa-zäöüéèàùçñóíáúêâîôûëï_]+){{0,3}}(?: {_CODE})?(?P<folio> {{3,}}{_D}{{1,5}})?")
_COPY = re.compile(r"[Ff][i1l][l1][ec] [c(e][o0]p[yv]: \S.*")
_TITLE = r"[^\W_a-z][\w@¦~(&'’.-]*"
_BAR = re.compile(rf"{_TITLE}(?: (?:{_TITLE}|et|&)){{0,3}} \| {_TITLE}(?: {_TITLE}){{0,3}}(?: {_CODE})?|(?:{_TITLE} ){{1,4}}(?:{_CODE} )?— {_TITLE}(?: (?:{_TITLE}|et|&)){{0,3}}")
_FIRM = re.compile(rf"{_TITLE}(?: (?:{_TITLE}|et|&)){{1,3}}")
_NO_LETTERS = re.compile(r"[\W\d_]+")
_SECTION = re.compile(r"\d{1,3}\. ")


def _swaps() -> dict[str, list[tuple[str, str]]]:
    made: dict[str, list[tuple[str, str]]] = {}
    for read, meant in CONFUSED:
        made.setdefault(read[0], []).append((read, meant))
    return made


_by_first = _swaps()


class Reader:
    """Decodes words against a vocabulary."""

    def __init__(self, vocabulary: frozenset[str], lexicon: Lexicon | None = None):
        self.words = vocabulary
        self.lexicon = lexicon or Lexicon()
        self.is_family = self.lexicon.is_family
        self.known: dict[str, str | None] = {}
        self.paths: dict[tuple[str, frozenset[int]], list[tuple[int, int, str, int]]] = {}
        self.trie = ahocorasick.Automaton()
        for word in vocabulary:
            self.trie.add_word(word, True)

    def read(self, word: str) -> str | None:
        """The vocabulary's word that ``word`` (lower case) stands for with at most two confusions, itself if it is one, else
        none. Fewer confusions win, then the first in order."""
        if word in self.words:
            return word
        if word in self.known:
            return self.known[word]
        layer, found = [(word, 0)], None
        if 3 <= len(word) <= 40:
            for _ in range(2):
                after: list[tuple[str, int]] = []
                for text, start in layer:
                    for i in range(start, len(text)):
                        for read, meant in _by_first.get(text[i], ()):
                            if text.startswith(read, i):
                                made = text[:i] + meant + text[i + len(read) :]
                                after.append((made, i + len(meant)))
                hits = [t for t, _ in after if t in self.words]
                if hits:
                    found = hits[0]
                    break
                layer = after
        if len(self.known) > 200_000:
            self.known.clear()
        self.known[word] = found
        return found

    def _words_from(self, s: str, i: int, most: float) -> Iterator[tuple[int, float, str, int]]:
        """Words of the vocabulary that ``s`` can be read as from ``i``: end, cost below ``most``, word, confusions."""
        stack = [(i, "", 0.0, 0)]
        while stack:
            j, text, cost, swaps = stack.pop()
            if j > i and text in self.words and s[j - 1] not in " \n-" and not (swaps and j - i < 3):
                yield j, cost, text, swaps
            if j == len(s) or len(text) > 60:
                continue
            c = s[j]
            if self.trie.match(text + c):
                stack.append((j + 1, text + c, cost, swaps))
            if c in " \n-" and text and s[j - 1] not in " \n-" and cost + ADDED < most:
                stack.append((j + 1, text, cost + (ADDED_LINE if c == "\n" else ADDED), swaps))
            if swaps < 2 and cost + CONFUSION < most:
                for read, meant in reversed(_by_first.get(c, ())):  # the first is looked at first
                    if s.startswith(read, j) and self.trie.match(text + meant):
                        stack.append((j + len(read), text + meant, cost + CONFUSION, swaps + 1))

    def decode(self, s: str, whole: frozenset[int] = frozenset()) -> list[tuple[int, int, str, int]]:
        """The cheapest reading of ``s`` (lower case, words parted by one blank, line end or hyphen): start, end, word and
        confusions of each word. Words that begin at a place in ``whole`` aren't parted."""
        if (s, whole) in self.paths:
            return self.paths[s, whole]
        def unknown(size: int) -> float:
            return UNKNOWN if size > 4 else UNKNOWN_SHORT

        # no path is of use that costs as much as to leave the unknown words
        limit = sum(unknown(len(w)) for w in _PARTS.findall(s) if w not in self.words)
        best: list[float] = [0.0] + [float("inf")] * len(s)
        back: list[tuple[int, str | None, int]] = [(0, None, 0)] * (len(s) + 1)

        def reach(at: int, cost: float, start: int, word: str | None, swaps: int) -> None:
            if cost < best[at] - 1e-9:
                best[at], back[at] = cost, (start, word, swaps)

        for i in range(len(s)):
            if best[i] == float("inf"):
                continue
            if s[i] in " \n-" and i:
                reach(i + 1, best[i], i, None, 0)
                continue
            first = i == 0 or s[i - 1] in " \n-"
            for j, cost, word, swaps in self._words_from(s, i, limit - best[i]):
                last = j == len(s) or s[j] in " \n-"
                if not last:
                    token = max(s.rfind(c, 0, j) for c in " \n-") + 1
                    if token in whole:
                        continue
                    cost += DROPPED
                if not (first and last) and len(word) < 3:
                    if len(word) == 1 and word not in SINGLE:
                        continue
                    cost += ONE if len(word) == 1 else TWO
                reach(j, best[i] + cost, i, word, swaps)
            if first:
                own_word = _PARTS.match(s, i)[0]
                reach(i + len(own_word), best[i] + unknown(len(own_word)), i, own_word, 0)
        out, at = [], len(s)
        while at:
            start, word, swaps = back[at]
            if word is not None:
                out.append((start, at, word, swaps))
            at = start
        if len(self.paths) > 50_000:
            self.paths.clear()
        self.paths[s, whole] = out = out[::-1]
        return out

    def cost(self, word: str) -> float:
        """Of the cheapest reading of ``word`` as one word."""
        if word in self.words:
            return 0.0
        costs = [c for j, c, _, _ in self._words_from(word, 0, UNKNOWN) if j == len(word)]
        return min(costs, default=UNKNOWN) if 3 <= len(word) <= 40 else UNKNOWN


def bare_line(line: str) -> str:
    """A line's letters in lower case, other characters as one blank: what running headers have in common."""
    return _NO_LETTERS.sub(" ", line.lower()).strip()


def _named_firm(line: str, reader: Reader) -> bool:
    """Whether a short line of capitalised words is a firm: a known family name and then no given name, or, however it was
    read, a kind of firm at its end."""
    words = re.findall(r"[^\s]+", line)
    if not (len(line) <= 48 and _FIRM.fullmatch(line)) or reader.lexicon._is_given(words[0]) or any(reader.lexicon._is_given(w) for w in words[1:2]):
        return False
    return (reader.is_family(words[0].lower()) and not words[0].isupper() and not reader.is_family(words[1].lower())) or reader.read(words[-1].lower()) in reader.lexicon.kinds and not words[-1].isupper()


def _furniture(lines: list[tuple[int, str]], reader: Reader, running: frozenset[str] = frozenset()) -> list[str | None]:
    """For each line ``header``, ``page_number`` or none. ``running``: lines, as ``bare_line`` gives them, of several pages."""
    bare = [t.strip() for _, t in lines]
    kinds: list[str | None] = [None] * len(lines)
    shouted: bool | None = None  # whether the whole text is in capitals, looked at only where a line is
    for i, t in enumerate(bare):
        if t and len(t) <= 24 and _PAGE.fullmatch(t):
            kinds[i] = "page_number"
    if len([t for t in bare if t]) < 2:
        return [None] * len(lines)
    for i, t in enumerate(bare):
        if kinds[i] or not 4 <= len(t) <= 110 or _SECTION.match(t):
            continue
        if _COPY.fullmatch(t) and not t.endswith("."):
            kinds[i] = "header"
        elif _BAR.fullmatch(t) and "@" not in t.replace("@r", "r") and not t.endswith("|"):
            kinds[i] = "header"
        elif _named_firm(t, reader):
            kinds[i] = "header"
        elif running and bare_line(t) in running:
            kinds[i] = "header"
    for i, t in enumerate(bare):
        if kinds[i] or not 4 <= len(t) <= 110:
            continue
        m = _UPPER.fullmatch(t)
        if m and shouted is None:
            whole = "".join(bare)
            letters = sum(map(str.isalpha, whole))
            shouted = sum(map(str.isupper, whole)) > 0.6 * letters and letters > 200
        if not m or shouted or sum(c.isalpha() for c in t) < 3 or any(c.islower() for c in t.replace("ß", "")):
            continue
        words = [w.lower() for w in re.findall(r"[^\s\d/]{3,}", t)]
        if not words or not any(reader.read(w) for w in words):
            continue
        before, after = bare[i - 1] if i else None, bare[i + 1] if i + 1 < len(bare) else None
        if m["folio"]:
            kinds[i] = "header"
        elif before == "" or after == "" or (i and kinds[i - 1] == "header"):
            continue  # a heading of the text stands apart
        elif before is None and (after is None or kinds[i + 1] is None):
            continue
        elif any(reader.is_family(w) for w in words):
            continue
        else:
            kinds[i] = "header"
    return kinds


def _breaks(lines: list[tuple[int, str]], kinds: list[str | None]) -> Iterator[tuple[int, int, re.Match, int]]:
    """Lines whose last word goes on in the next line of the body: the two lines, the match of word and mark, the start of
    the rest."""
    body = [i for i, kind in enumerate(kinds) if kind is None]
    for i, j in zip(body, body[1:], strict=False):
        bare = lines[i][1].rstrip(" \t")
        m = _MARK.search(lines[i][1], bare.rfind(" ") + 1) if bare[-1:] and bare[-1] in "-‐¬­" else None
        after = lines[j][1]
        start = len(after) - len(after.lstrip(" \t"))
        if m and start < len(after) and (after[start].isalpha() or after[start] in "@¦~(") and (j == i + 1 or all(kinds[k] for k in range(i + 1, j))):
            yield i, j, m, start


def _stretches(stream: str, tokens: list[tuple[int, str, str]]) -> Iterator[list[tuple[int, str, str]]]:
    """Open words with the words around that their readings can take in, parted by one blank, line end or hyphen each."""
    runs: list[list[tuple[int, str, str]]] = [[]]
    for t in tokens:
        last = runs[-1][-1] if runs[-1] else None
        if t[2] == "fixed":
            runs.append([])
        elif last is None or stream[last[0] + len(last[1]) : t[0]] in (" ", "\n", "-"):
            runs[-1].append(t)
        else:
            runs.append([t])
    for run in runs:
        first = stop = 0
        for k, t in enumerate(run):
            if t[2] == "open":
                if k - AROUND > stop:
                    if stop:
                        yield run[first:stop]
                    first = k - AROUND
                elif not stop:
                    first = max(0, k - AROUND)
                stop = k + AROUND + 1
        if stop:
            yield run[first:stop]


def examine(text: str | None, reader: Reader, running: frozenset[str] = frozenset()) -> tuple[list[tuple[int, str]], str | None]:
    """Noises of a page's text (position, kind), in order, and the repaired text. Null stays null. ``running``: see ``_furniture``."""
    if not text:
        return [], text
    lines: list[tuple[int, str]] = []
    at = 0
    for m in _LINE.finditer(text):
        lines.append((at, text[at : m.start()]))
        at = m.end()
    lines.append((at, text[at:]))
    kinds = _furniture(lines, reader, running)
    noises: list[tuple[int, str]] = []
    for (start, line), kind in zip(lines, kinds, strict=True):
        if kind:
            noises.append((start + len(line) - len(line.lstrip()), kind))
    # the body as one stream: where each of its characters stands in the text
    joins: dict[int, tuple[int, bool]] = {}  # line -> line of the rest, whether the mark was put in
    for i, j, m, start in _breaks(lines, kinds):
        left, mark = m[1], m[2]
        right = _RUN.match(lines[j][1], start)
        rest = right[0] if right else ""
        tail = lines[i][1].rstrip().split(" ")[-1][:-1]
        token = f"{tail}{mark}{lines[j][1][start:].split(' ')[0]}"
        whole = (left + rest).lower()
        if mark == "-":
            own = re.findall(r"[^\W\d_]+(?:-[^\W\d_]+)*$", tail.lower())
            hyphened = f"{own[0]}-{rest.lower()}" if own else ""
            as_own, as_one = reader.cost(hyphened) if hyphened else UNKNOWN, reader.cost(whole)
            if as_own < UNKNOWN and as_own <= as_one or reader.is_family(left.lower()) and not reader.is_family(whole):
                put = False
            elif as_one < UNKNOWN or reader.is_family(whole):
                put = True
            elif "@" in token or any(c.isdigit() for c in rest[:1]):
                put = "@" not in token
            else:
                put = rest[:1].islower() and not (left.lower() in reader.words and rest.lower() in reader.words and len(left) > 3 and len(rest) > 3)
        else:
            put = True
        joins[i] = (j, put)
        if put:
            noises.append((lines[i][0] + m.start(2), "hyphen"))
    stream: list[str] = []
    starts: list[int] = []  # in the stream, of each part of a line
    places: list[int] = []  # where they stand in the text
    size = skip = 0
    body = [i for i, kind in enumerate(kinds) if kind is None]
    for i in body:
        start, line = lines[i]
        line_from, line_to = skip, len(line)
        skip = 0
        if i in joins:
            line_to = len(line.rstrip())
            if joins[i][1]:
                line_to -= 1
            after = lines[joins[i][0]][1]
            skip = len(after) - len(after.lstrip(" \t"))
        part = line[line_from:line_to] if i in joins else f"{line[line_from:line_to]}\n"
        stream.append(part)
        starts.append(size)
        places.append(start + line_from)
        size += len(part)
    whole = "".join(stream)
    mails = [m.span() for m in _MAIL.finditer(whole)] if "@" in whole or "(at)" in whole or "[at]" in whole else []
    # words that stand for themselves, that are open, and that no reading goes over
    tokens: list[tuple[int, str, str]] = []
    for m in _RUN.finditer(whole):
        raw, start = m[0], m.start()
        low = raw.lower()
        state = "known" if low in reader.words else "fixed" if mails and any(a <= start < b for a, b in mails) else "open"
        if state == "open" and raw[0] == "(":
            inner = None if any(c in "0156@¦~(q" for c in low[1:]) else reader.read(low[1:])
            if low[1:] in reader.words or inner or reader.read(low) is None:
                raw, low, start = raw[1:], low[1:], start + 1
                state = "known" if low in reader.words else "open"
        if state == "open":
            digits = sum(c.isdigit() for c in low)
            if digits > 2 or digits * 2 > len(low) or low.isdigit() or len(lowered(raw)) != len(low) or len(low) > 60 or reader.is_family(low):
                state = "fixed"
        tokens.append((start, raw, state))
    fixes: list[tuple[int, int, str]] = []
    for run in _stretches(whole, tokens) if any(t[2] == "open" for t in tokens) else ():
        start, stop = run[0][0], run[-1][0] + len(run[-1][1])
        # a capitalised word within a sentence is a noun or name: no two words
        own = frozenset(t - start for t, raw, _ in run if not raw.isalpha() or not raw[1:].islower() or raw[0].isupper() and not (t == 0 or whole[:t].rstrip()[-1:] in ".!?:"))
        for a, b, meant, swaps in reader.decode(lowered(whole[start:stop]), own):
            raw = whole[start + a : start + b]
            if swaps:
                own_part = bisect_right(starts, start + a) - 1
                noises.append((places[own_part] + start + a - starts[own_part], "misread"))
            if swaps or meant != raw.lower():
                fixes.append((start + a, start + b, meant.upper() if raw.isupper() else meant[:1].upper() + meant[1:] if raw[:1].isupper() else meant))
            if start + b < stop and whole[start + b] not in " \n-":
                fixes.append((start + b, start + b, " "))
    noises.sort()
    return noises, _paragraphs(whole, fixes)


def _paragraphs(stream: str, fixes: list[tuple[int, int, str]]) -> str:
    """Repaired text: the fixes made, lines joined to paragraphs. Each line end is a border or not; the borders with the
    least total cost are chosen - of each border by the look of the two lines, of each paragraph by its length."""
    parts, last = [], 0
    for start, end, meant in fixes:
        parts += [stream[last:start], meant]
        last = end
    lines = [t for t in "".join([*parts, stream[last:]]).split("\n")]
    width = max((len(t) for t in lines), default=1) or 1
    rows: list[tuple[str, float]] = []  # text of a line, cost of a border before it (below 0: wanted)
    blank = False
    for t in lines:
        bare = t.strip()
        if not bare:
            blank = True
            continue
        cost = 1.0
        if rows:
            before = rows[-1][0]
            cost += -3.0 if blank else 0.0
            cost += -2.0 if t[:2].isspace() and len(t) > 2 else 0.0
            cost += -0.6 if before[-1] in ".!?:" and len(before) < 0.75 * width else 0.4 if before[-1] not in ".!?:" else 0.2
            cost += -0.2 if bare[0].isupper() else 0.8 if bare[0].islower() else 0.0
            cost += -1.5 if re.match(r"(?:[*•-]|\d{1,2}[.)]) ", bare) else 0.0
        rows.append((bare, cost))
        blank = False
    # in hundredths, so that sums are exact; ``passed``: cost of the wanted borders before a line that aren't taken
    costs = [round(100 * cost) for _, cost in rows]
    passed = [0]
    for cost in costs:
        passed.append(passed[-1] + max(0, -cost))
    best, back = [0], [0]
    least: tuple[int, int] | None = None  # over all beginnings three lines back or more, without what is passed
    for j in range(1, len(rows) + 1):
        options = [] if least is None else [least]
        for i in range(max(0, j - 3), j):
            size = sum(len(rows[k][0]) for k in range(i, j))
            options.append((best[i] + (costs[i] if i else 0) + (40 if size < 40 else 0) - passed[i + 1], i))
        if j > 2:
            least = min(options[0], options[1]) if least is not None else options[0]
        cost, i = min(options)
        best.append(cost + passed[j])
        back.append(i)
    out, j = [], len(rows)
    while j:
        out.append(" ".join(rows[k][0] for k in range(back[j], j)))
        j = back[j]
    return "\n\n".join(reversed(out))


def vocabulary(counts: DataFrame) -> list[str]:
    """Words (also with hyphens) of the texts without pages, as often as SHARE says, from the ``evidence`` of all texts."""
    words = counts.where("what = 'word'").select(F.col("a").alias("word"), "n")
    total = words.where("word = ''").agg(F.sum("n")).first()[0] or 0
    known = words.where((F.col("n") >= max(2, SHARE * total)) & (F.col("word") != "")).select("word").collect()
    return [r[0] for r in known]  # at most 1 / SHARE words


#: Documents with running headers up to which these are broadcast.
FEW = 20_000
#: Pages of a document on which a line must stand to be a running header, and share of its pages.
PAGES, OF_PAGES = 3, 0.2


def running_lines(pages: DataFrame) -> DataFrame:
    """``doc_id, running``: lines that stand on ``PAGES`` pages of a document and on the share ``OF_PAGES`` of all its
    pages at least, as ``bare_line`` gives them. Such a line has
    up to eight words, begins with a capital letter or digit and ends without a mark of a sentence."""
    lines = pages.where("text is not null and doc_id is not null").select("doc_id", "page", F.explode(F.array_distinct(F.split("text", r"\r\n|\n|\r"))).alias("line"))
    fit = lines.where(F.length("line").between(4, 110) & F.col("line").rlike(r"^\s*[\p{Lu}\d]\S*(?: +\S+){0,7}\s*$") & ~F.col("line").rlike(r"[.!?,;:\-‐¬\u00ad]\s*$"))
    bare = fit.select("doc_id", "page", F.trim(F.regexp_replace(F.lower("line"), r"[^\p{L}]+", " ")).alias("line")).where(F.length("line") > 3)
    often = bare.groupBy("doc_id", "line").agg(F.count_distinct("page").alias("n")).where(F.col("n") >= PAGES)
    all_pages = pages.where("doc_id is not null").groupBy("doc_id").agg(F.count_distinct("page").alias("pages"))
    often = often.join(all_pages, "doc_id").where(F.col("n") >= OF_PAGES * F.col("pages"))
    return often.groupBy("doc_id").agg(F.collect_set("line").alias("running"))  # the headers of one document


def scanned(chunks: DataFrame, key: str = "chunk_id") -> DataFrame:
    """``key, page, noises, repaired`` of every chunk with a page: noises as ``array<struct<pos,noise_kind>>`` and the text as
    continuous paragraphs. Null texts have no noises and stay null; repeated rows stay; with no text that has no page there
    is no vocabulary, so only furniture and plain line-end marks are found."""
    counts = cut(evidence(chunks, words_where=F.col("page").isNull()))
    words = chunks.sparkSession.sparkContext.broadcast((frozenset(vocabulary(counts)), shown(counts)))
    kind = pa.list_(pa.struct([("pos", pa.int32()), ("noise_kind", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(words.value[0], Lexicon(**words.value[1]))
        for batch in batches:
            made = [examine(t, reader, frozenset(r or ())) for t, r in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
            rows = pa.array([[{"pos": p, "noise_kind": k} for p, k in n] for n, _ in made], kind)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), rows, pa.array([t for _, t in made], pa.string())], ["key", "page", "noises", "repaired"])

    pages = chunks.where("page is not null").select(F.col(key).cast("long").alias(key), "doc_id", "page", "text")
    running = cut(running_lines(pages))
    few = running.limit(FEW + 1).count() <= FEW
    known = spread(pages).join(F.broadcast(running) if few else running, "doc_id", "left")
    source = known.select(F.col(key), "page", "text", "running")
    return source.mapInArrow(run, "key long, page int, noises array<struct<pos:int,noise_kind:string>>, repaired string").withColumnRenamed("key", key)


def noises(chunks: DataFrame, key: str = "chunk_id") -> DataFrame:
    """``key, pos, noise_kind``, one row a noise; rows repeated under one key count once."""
    return scanned(chunks, key).where(F.size("noises") > 0).select(key, F.inline("noises")).distinct()
