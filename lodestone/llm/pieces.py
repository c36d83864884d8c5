"""Problem 4: cutting oversized texts at natural boundaries, by bounded-quantifier patterns and SQL array functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LIMIT, OVERLAP = 1600, 200

_EOL = r"(?:\r\n|[\n\r\x0B\f\x85\u2028\u2029])"
_GAP = r"[\s\x1c-\x1f\x85\p{Z}]"
_INLINE = rf"(?:(?![\n\r\x0B\f\x85\u2028\u2029]){_GAP})"
_BLANK = rf"{_EOL}{_INLINE}*{_EOL}"
#: The same as it is looked for backwards, where Java's patterns need a bound: a line of more blanks counts as a line end.
_BLANK_BEFORE = rf"(?<={_EOL})(?<={_EOL}{_INLINE}{{0,255}}{_EOL})"
#: Where a text may be cut, from the strongest boundary to the weakest.
BOUNDARIES = {
    "paragraph": _BLANK,
    "sentence": rf"{_EOL}|(?<=[.!?]){_GAP}",
    "word": _GAP,
}


def trimmed(text: Column) -> Column:
    return F.regexp_replace(text, rf"\A{_GAP}+|{_GAP}+\z", "")


def break_kind(text: Column, limit: int = LIMIT) -> Column:
    """The first boundary whose cuts, with those of all stronger ones, leave no stretch above ``limit``; else none.

    By extraction: runs of up to ``limit`` characters that end at such a boundary or at the end of the text consume the text from
    its beginning; a place from which none does begins a longer stretch and is taken by the fallback, which is group 1."""
    found, made = None, F
    for kind, pattern in BOUNDARIES.items():
        found = pattern if found is None else f"{found}|{pattern}"
        runs = F.regexp_extract_all(text, F.lit(rf"(?s).{{1,{limit}}}+\z|.{{0,{limit}}}(?:{found})|(.{{{limit + 1}}})"), F.lit(1))
        made = made.when(F.forall(runs, lambda fallback: fallback == ""), kind)
    return made.otherwise("none")


def split_oversized(chunks: DataFrame, limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """Pieces of every chunk whose text without outer whitespace is longer than ``limit`` code points.

    ``chunk_id, doc_id, piece, text, char_start, char_end, page, break_kind``. Each match of one pattern takes up to
    ``limit - overlap`` characters that no piece had before, ending at the strongest boundary within reach - blank line,
    sentence or line end, whitespace, any character - and the piece begins ``overlap`` characters (or as many as there are)
    before them. Pieces are exact substrings: joined without their lookback they are the chunk's whole text, and
    ``char_start``/``char_end`` point to their place in the document (null if the chunk's are). Paragraph and
    sentence ends in the second half of a piece go first, so pieces don't become tiny; then those in the first half. Null texts and texts
    within the limit give no pieces; rows repeated under one ``chunk_id`` count once. ``page`` is the chunk's; ``paged`` has
    that of each piece.
    """
    if not 0 <= overlap < limit:
        raise ValueError("overlap must be at least 0 and below limit")
    fresh = limit - overlap
    half = max(1, fresh // 2)
    pattern = "(?s)" + "|".join(
        [
            rf"\A.{{1,{limit}}}\z",
            rf".{{1,{fresh}}}\z",
            rf".{{{half},{fresh}}}{_BLANK_BEFORE}",
            rf".{{{half},{fresh}}}(?:(?<={_EOL})|(?<=[.!?])(?={_GAP}))",
            rf".{{1,{half}}}{_BLANK_BEFORE}",
            rf".{{1,{half}}}(?:(?<={_EOL})|(?<=[.!?])(?={_GAP}))",
            rf".{{1,{fresh}}}(?={_GAP})",
            rf".{{1,{fresh}}}",
        ]
    )
    long = chunks.select("chunk_id", "doc_id", "text", "char_start", "page").where(F.length("text") > limit)
    long = long.withColumn("_inner", trimmed(F.col("text"))).where(F.length("_inner") > limit).dropDuplicates(["chunk_id"])
    runs = long.select("chunk_id", "doc_id", "text", "char_start", "page", break_kind(F.col("_inner"), limit).alias("break_kind"), F.regexp_extract_all("text", F.lit(pattern), F.lit(0)).alias("_runs"))
    ends = F.aggregate("_runs", F.array(F.lit(0)), lambda ends, run: F.concat(ends, F.array(F.element_at(ends, -1) + F.length(run))))
    cuts = F.transform(F.sequence(F.lit(1), F.size("_runs")), lambda i: F.struct((i - 1).alias("piece"), F.greatest(F.lit(0), F.element_at("_ends", i) - F.when(i == 1, 0).otherwise(overlap)).alias("start"), F.element_at("_ends", i + 1).alias("stop")))
    rows = runs.withColumn("_ends", ends).select("*", F.inline(cuts))
    return rows.select(
        "chunk_id", "doc_id", "piece",
        F.col("text").substr(F.col("start") + 1, F.col("stop") - F.col("start")).alias("text"),
        (F.col("char_start") + F.col("start")).alias("char_start"), (F.col("char_start") + F.col("stop")).alias("char_end"), "page", "break_kind",
    )


def paged(pieces: DataFrame, chunks: DataFrame) -> DataFrame:
    """``pieces`` with the page on which each begins: the last page of its document that a chunk shows to have begun at or before
    the piece, but none before its own chunk's. Pieces without offsets or in documents without pages keep their chunk's."""
    begun = chunks.where("doc_id is not null and page is not null and char_start is not null").groupBy("doc_id", "page").agg(F.min("char_start").alias("start"))
    pages = begun.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("start", "page"))).alias("_pages"))  # one entry a page
    before = F.filter("_pages", lambda p: p["start"] <= F.col("char_start"))
    own = F.greatest(F.when(F.size(before) > 0, F.element_at(before, -1)["page"]), "page")
    return pieces.join(pages, "doc_id", "left").withColumn("page", F.when(F.col("page").isNotNull(), own)).select(pieces.columns)
