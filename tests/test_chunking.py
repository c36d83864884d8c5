import random
import re

from hypothesis import given, settings
from hypothesis import strategies as st

from lodestone.operators import chunking

PARAS = "\n\n".join(f"Paragraph {i} has a sentence. And a second one with words! Right?" for i in range(80))


def test_offsets_and_cover():
    spans = chunking.chunk_spans(PARAS, 100)
    assert len(spans) > 3 and spans[0][0] == 0 and spans[-1][1] == len(PARAS)
    assert all(e - s <= 400 and PARAS[s:e] == PARAS[s:e].strip() for s, e in spans)
    for (s0, e0), (s1, _) in zip(spans, spans[1:]):
        assert s0 < s1 <= e0 + 2 and e0 - s1 <= 60


def test_unbroken_text_is_windowed():
    assert chunking.chunk_spans("x" * 10_000, 400) == [(i, min(i + 1600, 10_000)) for i in range(0, 10_000, 1600)]


def test_small_and_blank():
    assert chunking.chunk_spans("") == chunking.chunk_spans(None) == chunking.chunk_spans(" \n\n ") == []
    assert chunking.chunk_spans("  One short text.  ") == [(2, 17)]


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet=st.sampled_from("ab .!\n\té"), max_size=300), st.integers(2, 20))
def test_invariants(text, target):
    spans = chunking.chunk_spans(text, target)
    assert all(0 < e - s <= 4 * target and text[s:e].strip() == text[s:e] for s, e in spans)
    assert all(a < b for (a, _), (b, _) in zip(spans, spans[1:]))
    if any(c.isalnum() for c in text):
        assert spans


def plain_spans(text, target, overlap):
    """The definition step by step: sentences one after another, each chunk filled and stepped back segment by segment."""
    most, parts, low = target * 4, [], 0
    while low <= len(text):
        gap = re.compile(r"\n\s*\n").search(text, low)
        para = text[low : gap.start() if gap else len(text)]
        found = False
        for m in re.finditer(r"([\s\S]*?)((?:[.!?]+|\n)\s*|\Z)", para):
            if m[1]:
                found = True
                parts += [(x, min(x + most, low + m.end())) for x in range(low + m.start(), low + m.end(), most)]
        if not found and para.strip():
            parts += [(x, min(x + most, low + len(para))) for x in range(low, low + len(para), most)]
        low = gap.end() if gap else len(text) + 1
    out, i = [], 0
    while i < len(parts):
        inside = [p for p in parts[i:] if p[1] <= parts[i][0] + most] or [parts[i]]
        body = text[parts[i][0] : inside[-1][1]]
        if body.strip():
            start = parts[i][0] + len(body) - len(body.lstrip())
            out.append((start, start + len(body.strip())))
        after = i + len(inside)
        if after == len(parts):
            break
        again = [p for p in parts[i + 1 : after] if inside[-1][1] - p[0] <= int(most * overlap)]
        i = after - len(again)
    return out


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.sampled_from("abc .!?\n\té"), max_size=300), st.integers(2, 20), st.sampled_from([0.0, 0.15, 0.5]))
def test_spans_equal_the_plain_loop(text, target, overlap):
    assert chunking.chunk_spans(text, target, overlap) == plain_spans(text, target, overlap)


def test_pages():
    pages = [(1, 0), (2, 102), (3, 202)]
    assert [chunking.page_at(pages, x) for x in (0, 101, 102, 500)] == [1, 1, 2, 3]
    assert chunking.page_at([(4, 10)], 3) == 4 and chunking.page_at([], 3) is None


def test_table(spark):
    rows = [(1, PARAS), (2, None), (3, ""), (3, ""), (None, "a b.")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS chunk_idx", "1 AS page")
    got = chunking.chunk_documents(df, 100).collect()
    assert {r["doc_id"] for r in got} == {1, None} and all(PARAS[r["char_start"] : r["char_end"]] == r["text"] for r in got if r["doc_id"] == 1)


def test_reconstruction_equals_the_loop(spark, monkeypatch):
    monkeypatch.setattr(chunking, "SPAN", 25)
    rng, rows, want = random.Random(4), [], {}
    for doc in range(40):
        text = "".join(rng.choice("abcdefgh ") for _ in range(200))
        own = sorted((rng.randint(0, 150), rng.randint(1, 60)) for _ in range(rng.randint(1, 12)))
        out, end = "", 0
        for i, (s, n) in enumerate(own):
            rows.append((doc * 100 + i, doc, text[s : s + n], s, min(s + n, 200)))
            e = min(s + n, 200)
            if e > end:
                out += ("\n\n" if out and s > end else "") + text[max(s, end) : e]
                end = e
        want[doc] = out
    rows += [rows[0], (9999, 77, None, 0, 5), (9998, 78, "x", None, None)]
    df = spark.createDataFrame(rows, "chunk_id long, doc_id long, text string, char_start int, char_end int")
    assert {r["doc_id"]: r["text"] for r in chunking.reconstruct(df).collect()} == want
    parts = sorted(tuple(r) for r in chunking.reconstruct(df, most_chars=30).collect())
    assert max(r[1] for r in parts) > 2
    assert {doc: "".join(r[2] for r in parts if r[0] == doc) for doc in want} == want
