import pytest

from lodestone.llm import personal
from lodestone.llm.names import Lexicon

#: What a corpus would have shown for the cases below.
KNOWN = Lexicon(
    frozenset({"kestinski", "heskock", "fenvsson", "umbmora", "jarvowby", "pelvquist"}), frozenset({"jack", "corin", "rafe", "ana-sofía", "june"}), frozenset({"hexbridge", "selbrück", "kesselau", "puentealta", "rocablanca"})
)
CASES = [
    ("Dear Mr Jack Kestinski, call +44 20 7946 0985.", [("name", "Jack Kestinski"), ("phone", "+44 20 7946 0985")]),
    ("Heskock, Corin;order=78164660847", [("name", "Heskock, Corin")]),
    ("RAFE VON DER FENVSSON vive en C/ Harrow 183 antes", [("name", "RAFE VON DER FENVSSON"), ("address", "C/ Harrow 183")]),
    ("R. Umbmora and Ana-Sofía Jarv-\nowby", [("name", "R. Umbmora"), ("name", "Ana-Sofía Jarv-\nowby")]),
    ("Pelvquist Logistics sent June to Harrow Lane.", []),
    ("write to noor+club @ vaultmail.test or a_b (at) inbox dot example dot net.", [("email", "noor+club @ vaultmail.test"), ("email", "a_b (at) inbox dot example dot net")]),
    ("12 @ 20037.50, ask @facilities", []),
    ("Tel. 1 (555) 555 0163 ext. 602, 030/23125-058, 01.99.00.66.89", [("phone", "1 (555) 555 0163 ext. 602"), ("phone", "030/23125-058"), ("phone", "01.99.00.66.89")]),
    ("ID V-2233603-X, QQ 93 37 62 C, XX00 8080 2614 0874 7270, 9999-8126-7576-0125", [("id_number", x) for x in ("V-2233603-X", "QQ 93 37 62 C", "XX00 8080 2614 0874 7270", "9999-8126-7576-0125")]),
    ("Order no. 1721784505, Batch 94381568759, account 9724130264, code 000-414-849449565, ticket K18L-819", [("id_number", "9724130264")]),
    ("lives at Flat 4, 12 Chapel\nCourt, Hexbridge, 00381. Corranstraße 205, 09594 Selbrück; PO Box 6394, Kesselau", [("address", "Flat 4, 12 Chapel\nCourt, Hexbridge, 00381"), ("address", "Corranstraße 205, 09594 Selbrück"), ("address", "PO Box 6394, Kesselau")]),
    ("habite 172 bis avenue Copper, Puentealta. calle Quarry 23, 3º B, Rocablanca", [("address", "172 bis avenue Copper, Puentealta"), ("address", "calle Quarry 23, 3º B, Rocablanca")]),
    ("closed on 22/07/2021 at 07:45, 4.12.3, 1735.23", []),
]


@pytest.mark.parametrize("text,want", CASES)
def test_details(text, want):
    assert [(k, text[a:b]) for a, b, k in personal.spans(text, KNOWN)] == want


def test_masked_text_keeps_the_rest():
    text = "Call Jack Kestinski on 555-0188 today."
    assert personal.masked(text, personal.spans(text, KNOWN)) == "Call [NAME] on [PHONE] today."


def test_edges(spark, chunks):
    long = "filler " * 100_000 + "mail a.b@example.org"
    rows = [(1, None), (2, ""), (3, "John Kestinski"), (3, "John Kestinski"), (None, "John Kestinski"), (4, long), (5, "İİ John Kestinski")]
    got = {(r["chunk_id"], r["span_start"], r["span_end"], r["kind"]) for r in personal.personal_spans(chunks(rows)).collect()}
    assert got == {(3, 0, 14, "name"), (None, 0, 14, "name"), (4, len(long) - 15, len(long), "email"), (5, 3, 17, "name")}
    whole = personal.details(chunks(rows)).collect()
    assert len(whole) == 7 and [r["clean"] for r in whole if r["chunk_id"] in (1, 2)] == [None, ""]
    assert personal.personal_spans(chunks([])).count() == 0


def test_spans_never_overlap(spark, folder):
    for r in spark.read.parquet(f"{folder}/chunks.parquet").select("text").collect():
        last = 0
        for start, end, _ in personal.spans(r["text"]):
            assert last <= start < end and r["text"][start:end].strip() == r["text"][start:end]
            last = end


OPEN = [
    ("Please call John Smith or Maria Garcia, Mr J. R. Becker, mail john@x.org.", [("name", "John Smith"), ("name", "Maria Garcia"), ("name", "J. R. Becker"), ("email", "john@x.org")]),
    ("María García met Mr Zbigniew Kowalczyk.", [("name", "María García"), ("name", "Zbigniew Kowalczyk")]),
    ("Dear Aoife Brennan, thanks.", [("name", "Aoife Brennan")]),
    ("Tenant: Ngozi van den Okafor\n\nFrau Vogt kommt.", [("name", "Ngozi van den Okafor")]),
    ("Dear Harrow Team, John called. Smith Holdings, THOMAS SAID THAT", []),
    ("at 12 Baker Street, London NW1 6XE. Then", [("address", "12 Baker Street, London NW1 6XE")]),
    ("Lindenstraße 7, 10115 Berlin\nBitte; 40 Elm Road, Springfield, IL 62704.", [("address", "Lindenstraße 7, 10115 Berlin"), ("address", "40 Elm Road, Springfield, IL 62704")]),
    ("12 Chapel Court, 00381 Please call", [("address", "12 Chapel Court, 00381")]),
]


@pytest.mark.parametrize("text,want", OPEN)
def test_names_and_towns_of_no_list(text, want):
    assert [(k, text[a:b]) for a, b, k in personal.spans(text)] == want


def test_names_and_towns_known_from_other_texts(spark, chunks):
    seen = ["Dear Mr Aoife Brennan,", "Tenant: Aoife Quirk", "at 4 Elm Road, Leeds LS1 4AP", "Mrs Ngozi Okafor-Brennan and Ngozi Adeyemi", "Dear Ngozi Quirk"]
    text = "then A. Brennan and ngozi adeyemi, Okafor, Aoife, left 9 Oak Lane, Leeds today. Grace Period, brennan said. Aoife Street, QUIRK, NGOZI"
    got = personal.personal_spans(chunks([*enumerate(seen), (99, text)])).where("chunk_id = 99").collect()
    assert {text[r["span_start"] : r["span_end"]] for r in got} == {"A. Brennan", "ngozi adeyemi", "Okafor, Aoife", "9 Oak Lane, Leeds", "QUIRK, NGOZI"}


def test_numbers_need_check_digits_or_a_cue():
    kinds = lambda text: [(k, text[a:b]) for a, b, k in personal.spans(text)]
    assert kinds("see GB82 WEST 1234 5698 7654 32, DE89 3704 0044 0532 0130 00 and 4111 1111 1111 1111") == [("id_number", "DE89 3704 0044 0532 0130 00"), ("id_number", "4111 1111 1111 1111")]
    assert kinds("row DE00 3704 0044 0532 0130 00, 1234 5678 9012 3456 and 000-12-3456 in the table") == []
    assert kinds("card: 1234 5678 9012 3456. 666-12-3456 belongs to her; tel 212 555 0199") == [("id_number", "1234 5678 9012 3456"), ("id_number", "666-12-3456"), ("phone", "212 555 0199")]
    assert kinds("write to " + "a" * 60 + "@mail.example.org, mailto:b@c.org") == [("email", "a" * 60 + "@mail.example.org"), ("email", "b@c.org")]


SPELT = [
    ("write to jane[at]mail[dot]org or jo.b(at)mail(dot)org", [("email", "jane[at]mail[dot]org"), ("email", "jo.b(at)mail(dot)org")]),
    ("jane at mail.org, kim{at}post.inbox{dot}net", [("email", "jane at mail.org"), ("email", "kim{at}post.inbox{dot}net")]),
    ("Look at mail.org, we met at Harrow.Then", []),
    ("account number: 9724130264, Passport No. 926307279, tel:+44 20 7946 0985, order number 9724130264", [("id_number", "9724130264"), ("id_number", "926307279"), ("phone", "+44 20 7946 0985")]),
]


@pytest.mark.parametrize("text,want", SPELT)
def test_spelt_mails_and_labelled_numbers(text, want):
    assert [(k, text[a:b]) for a, b, k in personal.spans(text)] == want
