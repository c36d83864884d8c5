import random
import re


from lodestone.llm import pieces

LIMIT = 40


def kind_by_hand(text, limit):
    for kind, pattern in (("paragraph", r"\r?\n[ \t]*\r?\n"), ("sentence", r"\r?\n[ \t]*\r?\n|\r\n|[\n\r]|(?<=[.!?])\s"), ("word", r"\s")):
        if all(len(p) <= limit for p in re.split(pattern, text.strip())):
            return kind
    return "none"


def test_kinds_are_those_by_hand(spark, chunks):
    rng = random.Random(1)
    rows = [(i, "".join(rng.choice(["word ", "aaaaaaaaaa", ". ", "! ", "\n", "\n\n", "longish ", "x"]) for _ in range(rng.randint(8, 40)))) for i in range(300)]
    got = {r["chunk_id"]: r["break_kind"] for r in pieces.split_oversized(chunks(rows), LIMIT, 8).collect()}
    want = {i: kind_by_hand(t, LIMIT) for i, t in rows if len(t.strip()) > LIMIT}
    assert got == want


def test_pieces_are_within_the_limit_and_cover_the_text(spark, chunks):
    rng = random.Random(2)
    rows = [(i, "".join(rng.choice(["word ", "aaaaaaaaaa", ". ", "\r\n", "\n \n", "é😀", "x"]) for _ in range(rng.randint(0, 60)))) for i in range(200)]
    texts = dict(rows)
    by = {}
    for r in pieces.split_oversized(chunks(rows), LIMIT, 8).collect():
        assert 0 < len(r["text"]) <= LIMIT and texts[r["chunk_id"]][r["char_start"] : r["char_end"]] == r["text"]
        by.setdefault(r["chunk_id"], []).append((r["piece"], r["char_start"], r["char_end"]))
    assert set(by) == {i for i, t in rows if len(t.strip()) > LIMIT}
    for i, own in by.items():
        own.sort()
        assert own[0][1] == 0 and own[-1][2] == len(texts[i])
        for (_, _, end), (_, start, _) in zip(own, own[1:]):
            assert start == max(0, end - 8)


def test_cuts_prefer_strong_boundaries(spark, chunks):
    text = "One two three four five.\n\nSix seven eight nine ten eleven twelve"
    rows = sorted(pieces.split_oversized(chunks([(1, text)]), LIMIT, 0).collect(), key=lambda r: r["piece"])
    assert [r["text"].strip() for r in rows][0] == "One two three four five."


def test_edges(spark, chunks):
    rows = [(1, None), (2, ""), (3, " " * 500), (4, "x" * LIMIT + " " * 50), (5, "y" * 200_000), (5, "y" * 200_000), (6, "é" * (LIMIT + 1))]
    got = pieces.split_oversized(chunks(rows), LIMIT, 5).collect()
    assert {r["chunk_id"] for r in got} == {5, 6} and {r["break_kind"] for r in got} == {"none"}
    fives = sorted((r["piece"], r["char_end"]) for r in got if r["chunk_id"] == 5)
    assert len(fives) == len(set(fives)) and fives[-1][1] == 200_000
    assert pieces.split_oversized(chunks([]), LIMIT, 5).count() == 0



def test_blank_lines_of_many_and_other_spaces_are_paragraph_ends(spark, chunks):
    for blank in (" " * 100, "\t\u00a0\u3000"):
        text = f"One two three four five.\n{blank}\nSix seven eight nine ten eleven twelve"
        rows = sorted(pieces.split_oversized(chunks([(1, text)]), 140, 0).collect(), key=lambda r: r["piece"])
        assert len(rows) < 2 or rows[0]["text"].strip() == "One two three four five."


def test_page_of_a_piece_is_where_it_begins(spark, chunks):
    rows = [(1, 7, 0, "one two three four five six seven eight nine ten eleven", 0, 55, 1, None), (2, 7, 1, "eight", 34, 39, 2, None), (3, 8, 0, "x" * 50, 0, 50, None, None)]
    table = chunks(rows)
    got = sorted((r["chunk_id"], r["char_start"], r["page"]) for r in pieces.paged(pieces.split_oversized(table, LIMIT, 0), table).collect())
    assert [p for i, _, p in got if i == 1] == [1, 2] and {p for i, _, p in got if i == 3} == {None}


def test_sentence_ends_in_the_first_half_go_before_words(spark, chunks):
    text = "One two three. " + "four five six seven eight nine ten el." + " Twelve"
    rows = sorted(pieces.split_oversized(chunks([(1, text)]), LIMIT, 0).collect(), key=lambda r: r["piece"])
    assert [r["text"].strip() for r in rows] == ["One two three.", "four five six seven eight nine ten el.", "Twelve"]
