"""Problem 1: personal details in free text, found by anchors and expanded by local parsers.

An Aho-Corasick automaton finds at-signs, schemes, street words and the cues of own numbers and phones in one pass over the text;
a number's first digit is an anchor as well. Around each anchor a parser of that kind looks for the borders of a detail and
validates it: identity numbers by check digits where their format has some, or else by a cue. Names and towns are in no list: a
second automaton holds those that the whole corpus shows to be such (``names.learned``).
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.names import TOWN, TOWN_AFTER, Lexicon, learned, lowered
from lodestone.sources.tables import spread

#: Street words, what stands before a person's own number and behind it, and before a phone number. Fixed values.
STREETS_BEHIND = ("street", "st.", "road", "rd.", "rd", "lane", "ln.", "row", "hill", "close", "terrace", "court", "avenue", "ave.", "ave", "drive", "square", "place", "way")
STREETS_JOINED = ("straße", "strasse", "str.", "allee", "weg", "gasse", "platz", "ring", "damm")
STREETS_BEFORE = ("c/", "rue", "chemin", "avenue", "boulevard", "place", "impasse", "calle", "avenida", "paseo", "plaza", "camino")
OWN_NUMBER = (
    "account", "konto", "compte", "cuenta", "card used:", "card", "karte", "carte", "tarjeta", "passport", "passport=", "pass", "reisepass", "passeport", "pasaporte",
    "id", "id:", "id=", "ausweisnummer", "ausweis", "carte d'identité", "documento", "dni", "iban", "insurance no.", "insurance number", "security number is", "security number", "security no.", "versicherungsnummer", "sécurité sociale",
)

OWN_BEHIND = ("belongs to", "holder", "lives at", "titulaire", "titular", "a nombre", "au nom", "inhaber", "inhaberin", "lautend auf", "ausgestellt für")
PHONE_BEFORE = ("tel", "tel.", "tel:", "telephone", "phone", "mobile", "mobil", "fax", "cell", "call", "telefon", "rufen sie", "unter", "téléphone", "joindre", "appelez", "teléfono", "móvil", "llame")
SCHEMES = ("mailto:", "tel:", "sip:")

#: Ends of mail hosts, and words after which "at" leads to a site. Fixed values.
ENDINGS = "com org net edu gov info biz eu uk de fr es it nl be at ch us ca io test example".split()
SITE_BEFORE = (
    "look looks looked looking see seen visit visited find found available shop shopping order ordered online us me you it him her them read here is are was were be and or hosted register registered buy bought more details website "
    "site page pages shown listed posted published published apply book booked download downloaded documentation sold start started only also now free live not work works working arrive arrived out up"
).split()

_B = r"(?:[ \t ]|[ \t ]?\r?\n[ \t]?|\r)"  # one blank, or a line break within a detail
_FLAGS = re.IGNORECASE
_AT = r"(?:@|[(\[{<]\s?at\s?[)\]}>])"
_spelt = rf"(?:{_B}dot{_B}|{_B}?[(\[{{<]\s?dot\s?[)\]}}>]{_B}?)"
_point = rf"(?:\.|{_spelt})"
_label = r"[a-z0-9](?:[a-z0-9-]*[a-z0-9])?"
_EMAIL = re.compile(
    rf"(?<![\w.+@-])[a-z0-9](?:[\w.+%-]*[\w+%-])?(?:{_B}?{_AT}{_B}?{_label}(?:{_point}{_label})*?{_point}[a-z]{{2,}}(?:{_point}[a-z]{{2,}})*|{_B}at{_B}{_label}(?:{_spelt}{_label})*?{_spelt}[a-z]{{2,}}(?:{_spelt}[a-z]{{2,}})*)(?![\w@])", _FLAGS | re.ASCII
)
#: A spelt at with real points: what stands before it must not be a word that a site follows.
_EMAIL_AT = re.compile(
    rf"(?<![\w.+@'-])(?!(?:{'|'.join(SITE_BEFORE)}){_B})[a-z0-9](?:[\w.+%-]*[\w+%-])?{_B}at{_B}{_label}(?:\.{_label})*\.(?:{'|'.join(ENDINGS)})(?![\w@]|[./-]\w)", _FLAGS | re.ASCII
)

_H = r"-(?:\r?\n)?"
_S = rf"(?:{_H}|[  -]|{_B})"
_PHONE = re.compile(
    r"(?:"
    rf"(?:\+|00)1(?:\.|{_S})?\(?\d{{3}}\)?{_S}\d{{3}}{_S}\d{{4}}"
    rf"|1{_S}\(\d{{3}}\){_S}?\d{{3}}{_S}\d{{4}}"
    rf"|\(\d{{3}}\){_S}?\d{{3}}{_S}\d{{4}}"
    rf"|\+44{_S}\(?0?\)?\d{{2}}{_S}\d{{4}}{_S}\d{{4}}|020{_S}\d{{4}}{_S}\d{{4}}"
    rf"|\+49{_S}\(?0?\)?\d{{2,4}}{_S}\d{{4,6}}{_S}\d{{2,4}}|0049\d{{2,3}}{_S}\d{{6,8}}|0\d{{2,4}}/\d{{4,6}}{_H}\d{{2,4}}"
    rf"|\+33{_S}\(?0?\)?[1-9](?:{_S}\d\d){{4}}|0[1-9](?:\.\d\d){{4}}|0[1-9](?: \d\d){{4}}"
    rf"|\+34{_S}\d{{3}}{_S}\d{{2,3}}{_S}\d{{2,3}}(?:{_S}\d{{2,3}})?"
    rf"|\d{{3}}\.\d{{3}}\.\d{{4}}|\d{{3}}{_H}\d{{3}}{_H}\d{{4}}|[2-9]\d\d{_H}\d{{4}}"
    rf")(?:{_B}?,?{_B}?(?:ext\.?|extension|x|durchwahl|app\.|poste){_B}?\d{{1,5}})?(?![\d]|[./-]\d)", _FLAGS
)
_ID = re.compile(
    r"(?:"
    rf"[a-z]{{2}}\d{{2}}(?:\d{{12,26}}|(?:{_S}\d{{4}}){{3,6}}(?:{_S}\d{{1,4}})?)"
    rf"|\d{{4}}(?:{_S}\d{{4}}){{3}}"
    rf"|[a-z]{{2}}{_B}?\d\d{_B}?\d\d{_B}?\d\d{_B}?[a-z]"
    rf"|[a-z]{_H}\d{{7,8}}{_H}[a-z]|[a-z]\d\d[a-z]\d{{5}}"
    rf"|\d{{3}}{_H}\d\d{_H}\d{{4}}|\d{{3}}{_B}\d\d{_B}\d{{4}}"
    r")(?![\w]|[./-]\w)", _FLAGS
)
_NUMBER = re.compile(r"\d")
_STARTS = re.compile(r"(?<![\w/.-])(?:\d|(?:flat|apartment|apt|unit|suite)\b|p\.?\s?o\.?\s)", _FLAGS)
_TAIL = re.compile(r"[\w-]*\Z")
_CALLED = re.compile(r"(?:\+|00)?\(?\d{2,4}\)?(?:[ .-]\d{2,4}){1,4}(?![\w]|[./-]\d)")
_PLAIN = re.compile(r"\d{8,12}(?![\w]|[./-]\d)")
_cue = "|".join(sorted((re.escape(c).replace(r"\ ", rf"{_B}+") for c in OWN_NUMBER), key=len, reverse=True))
_no = rf"(?:{_B}(?:number|no\.?|nr\.?|nummer|n[°º]|num\.?|número|numéro))?"
_OWN = re.compile(rf"(?:^|(?<=[^\w])){'(?:' + _cue + ')'}{_no}{_B}?[:=#]?{_B}{{0,2}}$", _FLAGS)
_DIGIT = re.compile(r"(?<![\d])(?<!\d[.,/-])\d")

_post = rf"(?:(?:[a-z]{{2}}{_B})?\d{{5}}(?:-\d{{4}})?|[a-z]{{1,2}}\d{{1,2}}[a-z]?{_B}\d[a-z]{{2}})(?!\w)"
_place = rf"(?:,{_B}+(?-i:{TOWN}),?{_B}+{_post}|,{_B}+{_post}[ \xa0](?-i:{TOWN_AFTER})|,{_B}*{_post})"
_word = r"[^\W\d_]+(?:['’-][^\W\d_]+)*"
_behind = "|".join(re.escape(s) for s in sorted(STREETS_BEHIND, key=len, reverse=True))
_joined = "|".join(re.escape(s) for s in sorted(STREETS_JOINED, key=len, reverse=True))
_before = "|".join(map(re.escape, STREETS_BEFORE))
_number = r"\d{1,4}[a-z]?(?![\w])"
_ADDRESS = re.compile(
    r"(?<![\w/.-])(?:"
    rf"\d{{1,4}}[a-z]?,?{_B}+(?:(?:bis|ter),?{_B}+)?(?:{_before}){_B}+(?:(?:de|du|des|la|le|del){_B}+)*{_word}(?:{_place})?"
    rf"|(?:(?:flat|apartment|apt\.?|unit|suite){_B}+\d+[a-z]?,?{_B}+)?\d{{1,4}}[a-z]?{_B}+(?:{_word}{_B}+){{1,2}}?(?:{_behind})(?!\w)(?:{_place})?"
    rf"|(?:{_before}){_B}+(?:(?:de|la|del|los){_B}+)*{_word},?{_B}+{_number}(?:,{_B}*\d{{1,2}}[ºª°o]\.?{_B}?[a-z]?(?!\w))?(?:{_place})?"
    rf"|[^\W\d_][\w-]*?(?:{_joined}){_B}+{_number}(?:{_place})?"
    rf"|(?:p\.?{_B}?o\.?{_B}+box|postfach|apartado){_B}+\d+(?:{_place})?"
    r")", _FLAGS
)

_BREAK = re.compile(r"[-‐¬­][ \t]?(?:\r\n|\n|\r)(?=[^\W\d_])")


def _automaton() -> ahocorasick.Automaton:
    """Keys with their kind; cues stand behind a blank, line end or mark, which is part of the key."""
    made = ahocorasick.Automaton()
    for mark in ("@", "(at)", "[at]", "{at}", "<at>", "( at )", "[ at ]", " at ", "\nat ", " at\n"):
        made.add_word(mark, (len(mark), "email"))
    for word in (*STREETS_BEHIND, *STREETS_BEFORE, "box", "postfach", "apartado"):
        made.add_word(word, (len(word), "street"))
    for word in STREETS_JOINED:
        made.add_word(word, (len(word), "joined"))
    for words, kind in ((OWN_NUMBER, "own"), (OWN_BEHIND, "behind"), ((*PHONE_BEFORE, *SCHEMES), "call")):
        for word in words:
            for mark in " \n(;|,\t*\"":
                made.add_word(mark + word, (len(word), kind))
    made.make_automaton()
    return made


_anchors = _automaton()
#: Characters before and behind an anchor that a detail can reach: a mail address has at most 64 and 255 of them; an address line.
REACH = {"email": (66, 340), "street": (120, 240), "joined": (120, 240)}
#: Characters between a cue and the number it belongs to, or between the number and a cue behind it.
CUE_REACH, CUE_BEHIND = 60, 4


def _mail(text: str, start: int, end: int) -> tuple[int, int] | None:
    """The mail address whose at-sign, in whatever spelling, is the anchor: its local part ends there."""
    before, behind = REACH["email"]
    last = start
    while last > 0 and text[last - 1] in " \t\xa0\r\n" and start - last < 3:
        last -= 1
    first = last
    while first > 0 and last - first < before and (text[first - 1].isalnum() or text[first - 1] in "_.+%-"):
        first -= 1
    if first == last:
        return None
    stop = min(len(text), end + behind)
    m = _EMAIL.match(text, first, stop)
    if m is None and text[start:end].strip().lower() == "at":
        m = _EMAIL_AT.match(text, first, stop)
    return m.span() if m and m.end() >= end else None


def _address(text: str, start: int, end: int, kind: str) -> tuple[int, int] | None:
    """The first address that holds the street word: it begins at a number, flat or box before it, or at the word itself."""
    before, behind = REACH[kind]
    if kind == "joined":
        own = [start - len(_TAIL.search(text, max(0, start - before), start)[0])]
    else:
        own = [*(m.start() for m in _STARTS.finditer(text, max(0, start - before), start)), start]
    for at in own:
        m = _ADDRESS.match(text, at, min(len(text), end + behind))
        if m and m.end() >= end:
            return m.span()
    return None


def _checked(number: str) -> bool:
    """Whether check digits hold: the IBAN's remainder, or the card's sum."""
    bare = re.sub(r"\W", "", number).upper()
    if bare[:2].isalpha() and bare[2:4].isdigit() and len(bare) > 14:
        return int("".join(str(int(c, 36)) for c in bare[4:] + bare[:4])) % 97 == 1
    if bare.isdigit() and len(bare) == 16:
        digits = [int(c) for c in reversed(bare)]
        return (sum(digits[::2]) + sum(sum(divmod(2 * d, 10)) for d in digits[1::2])) % 10 == 0
    return False


_common = Lexicon()


def spans(text: str | None, lexicon: Lexicon = _common) -> list[tuple[int, int, str]]:
    """The details of a text in order: start, end, kind; ``lexicon`` has the names and towns known. Details don't overlap; of two the one that begins first, then the
    longer one, stays. None for null and empty texts."""
    if not text:
        return []
    # words broken at line ends are joined for the search; ``cuts`` leads back to the places in the text
    cuts: list[tuple[int, int]] = []
    if "\n" in text or "\r" in text:
        parts, last, gone = [], 0, 0
        for m in _BREAK.finditer(text):
            parts.append(text[last : m.start()])
            gone += m.end() - m.start()
            cuts.append((m.end() - gone, gone))
            last = m.end()
        source = "".join([*parts, text[last:]]) if cuts else text
    else:
        source = text
    low = lowered(source)
    found: list[tuple[int, int, str]] = []
    done = dict.fromkeys(("email", "street", "joined"), -1)
    cues: dict[str, list[int]] = {"own": [], "behind": [], "call": []}
    for at, (length, kind) in _anchors.iter("\n" + low):
        start, end = at - length, at
        if kind in cues:
            if end == len(low) or not (low[end].isalnum() and low[end - 1].isalnum()):
                cues[kind].append(start if kind == "behind" else end)
            continue
        if start < done[kind]:
            continue
        if kind == "email":
            span = _mail(source, max(0, start), end)
            if span:
                found.append((*span, "email"))
        else:
            # whole words beside a house number, or the end of a word before it
            if low[end : end + 1].isalnum() or (kind == "street" and start > 0 and low[start - 1].isalnum()):
                continue
            near = (max(0, start - 60), end + 60) if kind == "street" else (end, end + 6)
            if not _NUMBER.search(source, *near):
                continue
            span = _address(source, max(0, start), end, kind)
            if span:
                span = (span[0], lexicon.place(source, span[1]))
                found.append((*span, "address"))
        if span:
            done[kind] = span[1]
    found += [(start, end, "name") for start, end, _ in lexicon.names(source, low)]
    own, behind, call = cues["own"], cues["behind"], cues["call"]

    def cued(start: int, end: int) -> bool:
        at, after = bisect_right(own, start), bisect_left(behind, end)
        return (at > 0 and start - own[at - 1] <= CUE_REACH) or (after < len(behind) and behind[after] - end <= CUE_BEHIND)

    at = 0
    while (m := _DIGIT.search(source, at)) is not None:
        i = at = m.start()
        at += 1
        hit = None
        first = i
        if i and source[i - 1] in "(+":
            first = i - 2 if i > 1 and source[i - 2] == "+" else i - 1
        if not (first and (source[first - 1].isalnum() or source[first - 1] in "@_")):
            hit = _PHONE.match(source, first) or (_PHONE.match(source, i) if first < i and not source[i - 1] == "+" else None)
            if hit is None and call and (near := bisect_right(call, first)) and first - call[near - 1] <= 3:
                hit = _CALLED.match(source, first)
                if hit and not 7 <= sum(map(str.isdigit, hit[0])) <= 15:
                    hit = None
            kind = "phone"
        if hit is None:
            kind = "id_number"
            for j in (i - 3, i - 2, i - 1, i):
                if j >= 0 and not (j and (source[j - 1].isalnum() or source[j - 1] in "@_-/.")) and (j == i or source[j].isalpha()):
                    hit = _ID.match(source, j)
                    if hit and (_checked(hit[0]) or cued(j, hit.end())):
                        break
                    hit = None
        if hit is None and own and not (i and (source[i - 1].isalnum() or source[i - 1] in "-/.")):
            hit = _PLAIN.match(source, i)
            if hit and not _OWN.search(source[max(0, i - 40) : i]):
                hit = None
        if hit is None:
            while at < len(source) and source[at].isdigit():
                at += 1
            continue
        found.append((hit.start(), hit.end(), kind))
        at = hit.end()
    found.sort(key=lambda s: (s[0], -s[1]))
    out: list[tuple[int, int, str]] = []
    for start, end, kind in found:
        if out and start < out[-1][1]:
            continue
        out.append((start, end, kind))
    if cuts:
        def back(x: int, is_end: bool) -> int:
            gone = 0
            for place, total in cuts:
                if place > x or (is_end and place == x):
                    break
                gone = total
            return x + gone

        out = [(back(s, False), back(e, True), k) for s, e, k in out]
    return out


def masked(text: str | None, found: list[tuple[int, int, str]]) -> str | None:
    """``text`` with each detail replaced by its kind in brackets, all else as it is."""
    if text is None:
        return None
    parts, last = [], 0
    for start, end, kind in found:
        parts += [text[last:start], f"[{kind.upper()}]"]
        last = end
    return "".join([*parts, text[last:]])


def details(chunks: DataFrame, key: str = "chunk_id", with_text: bool = True) -> DataFrame:
    """``key, found, clean`` of every row of ``chunks``: the details as ``array<struct<span_start,span_end,kind>>`` and the text with
    typed placeholders (null if not asked for). Null texts have an empty list and stay null; repeated rows stay repeated."""

    known = chunks.sparkSession.sparkContext.broadcast(learned(chunks))
    kind = pa.list_(pa.struct([("span_start", pa.int32()), ("span_end", pa.int32()), ("kind", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon = Lexicon(**known.value)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            found = [spans(t, lexicon) for t in texts]
            clean = [masked(t, f) for t, f in zip(texts, found, strict=True)] if with_text else [None] * len(texts)
            rows = pa.array([[{"span_start": s, "span_end": e, "kind": k} for s, e, k in f] for f in found], kind)
            yield pa.RecordBatch.from_arrays([batch.column(0), rows, pa.array(clean, pa.string())], ["key", "found", "clean"])

    source = spread(chunks.select(F.col(key).cast("long"), "text"))
    return source.mapInArrow(run, "key long, found array<struct<span_start:int,span_end:int,kind:string>>, clean string").withColumnRenamed("key", key)


def personal_spans(chunks: DataFrame, key: str = "chunk_id") -> DataFrame:
    """``key, span_start, span_end, kind``, one row a detail; rows repeated under one key count once."""
    rows = details(chunks.where("text is not null"), key, with_text=False).where(F.size("found") > 0)
    return rows.select(key, F.inline("found")).distinct()
