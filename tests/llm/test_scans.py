from pyspark.sql import functions as F

from lodestone.llm import scans
from lodestone.llm.names import Lexicon, evidence, learned

WORDS = frozenset("the committee reviewed a long-term long term budget number treasurer approved delivery holdings seguros summary warm copy file provided under new plan sign-off sign off mortgage".split())


def found(text):
    lexicon = Lexicon(frozenset({"dranwick"}), kinds=frozenset({"holdings"}))
    return [(k, text[p : p + 12].split()[0] if k != "hyphen" else text[p]) for p, k in scans.examine(text, scans.Reader(WORDS, lexicon))[0]]


def test_hyphens_put_in_and_own():
    assert found("the long-\nterm bud-\nget and the sign-\noff, pro¬ \nvided") == [("hyphen", "-"), ("hyphen", "¬")]


def test_misread_words():
    assert found("the nurnber and tr@asurer\nof budqet W4RM delivcry") == [("misread", "nurnber"), ("misread", "budqet"), ("misread", "delivcry")]
    text, repaired = "the nurnber\nof the budqet", None
    _, repaired = scans.examine(text, scans.Reader(WORDS))
    assert repaired == "the number of the budget"


def test_furniture_and_headings():
    text = "the committee reviewed\n- 2 -\nDranwick Holdings\nthe budget.\n\nWARM SUMMARY\n\nthe plan.\nWARM DELIVERY     3\nPage 3 of l\n2. Warm Summary\nthe new plan 2021."
    assert found(text) == [("page_number", "-"), ("header", "Dranwick"), ("header", "WARM"), ("page_number", "Page")]


def test_lines_of_several_pages_are_headers(spark, chunks):
    rows = [(i, 1, i, f"the committee reviewed the\nNotes of {i} June\nbudget of the plan {i}.", 100 * i, 0, i, None) for i in range(1, 5)]
    rows += [(9, 2, 0, "the committee reviewed the\nNotes of 1 June\nbudget of the plan.", 0, 0, 1, None)]
    got = {(r["chunk_id"], r["noise_kind"]) for r in scans.noises(chunks(rows)).collect()}
    assert got == {(i, "header") for i in range(1, 5)}


def test_word_over_a_page_border():
    text = "the mort-\n- 1 -\nFile copy: Warm Summary\ngage of the budget"
    noises, repaired = scans.examine(text, scans.Reader(WORDS))
    assert [k for _, k in noises] == ["hyphen", "page_number", "header"] and repaired == "the mortgage of the budget"


def test_paragraphs():
    text = "the committee reviewed a long\nbudget of the treasurer.\n\nThe new plan\nwas approved."
    assert scans.examine(text, scans.Reader(WORDS))[1].count("\n\n") == 1


def test_edges(spark, chunks):
    rows = [(i, 1, 0, t, 0, 0, p, None) for i, t, p in ((1, None, 1), (2, "", 1), (3, "the bud-\nget", 2), (3, "the bud-\nget", 2), (4, "the bud-\nget", None), (5, "the budget " * 3000 + "bud-\nget", 3), (6, "   \n\n", 1))]
    rows += [(100 + i, 1, 0, "the budget of the committee", 0, 0, None, None) for i in range(3)]
    got = {(r["chunk_id"], r["noise_kind"]) for r in scans.noises(chunks(rows)).collect()}
    assert got == {(3, "hyphen"), (5, "hyphen")}
    whole = scans.scanned(chunks(rows)).collect()
    assert len(whole) == 6 and {r["repaired"] for r in whole if r["chunk_id"] in (1, 2, 3)} == {None, "", "the budget"}
    assert scans.noises(chunks([])).count() == 0


def test_family_names_of_no_list_are_no_damage(spark, chunks):
    assert [k for _, k in scans.examine("the hartrnan", scans.Reader(WORDS | {"hartman"}, Lexicon(frozenset({"hartrnan"}))))[0]] == []
    rows = [(i, 1, 0, t, 0, 0, None, None) for i, t in enumerate(["Mr John Abernathy came.", "the committee reviewed", "the committee"])]
    assert "abernathy" in learned(chunks([(1, "Mr John Abernathy came.")]))["family"]
    assert set(scans.vocabulary(evidence(chunks(rows), F.col("page").isNull()))) == {"the", "committee"}


def test_joint_reading_of_blanks_and_damage():
    words = scans.Reader(WORDS | {"document", "of", "in", "insurance", "house", "work"})
    cases = (
        ("the docu rnent of", "the document of", ["docu"]),  # blank added, and a confusion
        ("plan ofthc committee", "plan of the committee", ["thc"]),  # blank dropped, and a confusion
        ("plan ofthe budget", "plan of the budget", []),  # a word of two letters
        ("Thebudget abudget", "The budget a budget", []),
        ("the in surancc plan", "the insurance plan", ["in"]),  # together with a known word
        ("the commit-tee of", "the committee of", []),
        ("the com\nmit tee of", "the committee of", []),
        ("the Workhouse onde of the", "the Workhouse onde of the", []),  # a noun, and too short a word to tell
    )
    for text, want, places in cases:
        noises, repaired = scans.examine(text, words)
        assert repaired == want and [text[p : p + len(w)] for (p, _), w in zip(noises, places, strict=True)] == places, (text, noises, repaired)


def test_paragraphs_of_many_lines_stay_whole():
    text = "\n".join(["the committee reviewed a long budget of the"] * 150)
    assert "\n\n" not in scans.examine(text, scans.Reader(WORDS))[1]
