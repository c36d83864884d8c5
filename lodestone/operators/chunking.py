"""Overlapping chunks with exact offsets, and the way back to the text."""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions.text import CHARS_PER_TOKEN
from lodestone.sources.tables import spread

#: What parts paragraphs, and what ends a sentence with the blanks behind it. Fixed values.
_BLANK_LINES = re.compile(r"\n\s*\n")
_STOPS = re.compile(r"(?:[.!?]+|\n)\s*")


def segments(text: str, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the sentences within paragraphs; longer ones in windows of ``most`` characters.

    A sentence reaches to the end of the blanks behind its marks or line end; marks without a sentence before them are left
    out, a paragraph of nothing but marks is one segment, a blank one none.
    """
    edges = [0, *chain.from_iterable(m.span() for m in _BLANK_LINES.finditer(text)), len(text)]
    starts: list[int] = []
    ends: list[int] = []
    for low, high in zip(edges[::2], edges[1::2], strict=True):
        stops = np.array([*(m.span() for m in _STOPS.finditer(text, low, high)), (high, high)])
        heads = np.r_[low, stops[:-1, 1]]
        whole = stops[:, 0] > heads
        if whole.any():
            heads, tails = heads[whole], stops[whole, 1]
        elif text[low:high].strip():
            heads, tails = np.array([low]), np.array([high])
        else:
            continue
        for head, tail in zip(heads.tolist(), tails.tolist(), strict=True):
            windows = range(head, tail, most)
            starts += windows
            ends += [*windows[1:], tail]
    return np.array(starts, np.int64), np.array(ends, np.int64)


def chunk_spans(text: str | None, target_tokens: int = 400, overlap: float = 0.15) -> list[tuple[int, int]]:
    """Spans of the chunks of ``text``: as many whole segments as fit into the target, each chunk beginning with those last
    segments of the one before that fit into the overlap, but at least one segment further on. Outer blanks are cut off.

    Where a chunk that begins with some segment ends, and where the next one begins, is looked up for all segments at once;
    the chunks are then the chain from the first.
    """
    most = target_tokens * CHARS_PER_TOKEN
    starts, ends = segments(text, most) if text else (np.empty(0, np.int64), np.empty(0, np.int64))
    if not len(starts):
        return []
    own = np.arange(len(starts))
    last = np.maximum(own, np.searchsorted(ends, starts + most, "right") - 1)
    onward = np.clip(np.searchsorted(starts, ends[last] - int(most * overlap), "left"), own + 1, last + 1)
    out, at = [], 0
    while at < len(own):
        body = text[starts[at] : ends[last[at]]]
        size = len(body.strip())
        if size:
            start = int(starts[at]) + len(body) - len(body.lstrip())
            out.append((start, start + size))
        at = int(onward[at]) if last[at] + 1 < len(own) else len(own)
    return out


def page_at(pages: list[tuple[int, int]], offset: int) -> int | None:
    """Of pages ``(page, start)`` in order, the last that starts at or before ``offset``; the first if there is none."""
    return pages[max(0, bisect_right([s for _, s in pages], offset) - 1)][0] if pages else None


def page_lookup(pages: Column, offset: Column) -> Column:
    """``page_at`` as an expression over ``array<struct<page,start>>``."""
    before = F.filter(pages, lambda p: p["start"] <= offset)
    return F.when(F.size(pages) > 0, F.when(F.size(before) > 0, F.element_at(before, -1)["page"]).otherwise(F.element_at(pages, 1)["page"]))


def chunk_documents(documents: DataFrame, target_tokens: int = 400, overlap: float = 0.15) -> DataFrame:
    """``doc_id, chunk_idx, text, char_start, char_end, page`` of ``doc_id, text`` and, if there is one, a column ``pages``
    (``array<struct<page,start>>``). Null, empty and blank texts have no chunks; repeated rows repeat theirs."""
    paged = "pages" in documents.columns
    source = spread(documents.where("text is not null").select("doc_id", "text", *(["pages"] if paged else [])))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "chunk_idx", "text", "char_start", "char_end", "page"]
        kinds = [pa.int64(), pa.int32(), pa.string(), pa.int32(), pa.int32(), pa.int32()]
        for batch in batches:
            rows: list[tuple] = []
            for row in batch.to_pylist():
                pages = [(p["page"], p["start"]) for p in row.get("pages") or []]
                for i, (start, end) in enumerate(chunk_spans(row["text"], target_tokens, overlap)):
                    rows.append((row["doc_id"], i, row["text"][start:end], start, end, page_at(pages, start)))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)], names)

    return source.mapInArrow(run, "doc_id long, chunk_idx int, text string, char_start int, char_end int, page int")


#: Characters of a document that are one block when the furthest end so far is looked up.
SPAN = 1_000_000


def fresh_parts(chunks: DataFrame) -> DataFrame:
    """What each chunk adds to its document: ``doc_id, chunk_id, char_start, fresh_start, char_end, gap, fresh``.

    Chunks come by start; one that ends within what is there adds nothing and is left out. ``gap``: characters are missing
    before it (never before the first). The furthest end before a chunk is found in two steps, within blocks of ``SPAN``
    characters and over the blocks, so that no task needs all chunks of a long document. Chunks with null offsets or texts
    are left out, rows repeated under one id count once, equal starts go by id.
    """
    own = chunks.where("char_start is not null and char_end is not null and text is not null").dropDuplicates(["chunk_id"])
    own = own.select("doc_id", "chunk_id", "text", "char_start", "char_end", F.floor(F.col("char_start") / SPAN).alias("block"))
    within = Window.partitionBy("doc_id", "block").orderBy("char_start", "chunk_id").rowsBetween(Window.unboundedPreceding, -1)
    blocks = own.groupBy("doc_id", "block").agg(F.max("char_end").alias("block_end"))
    over = Window.partitionBy("doc_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    before = blocks.select("doc_id", "block", F.max("block_end").over(over).alias("before"))
    ended = own.withColumn("inside", F.max("char_end").over(within)).join(before, ["doc_id", "block"])
    end = F.greatest(F.coalesce("inside", F.lit(0)), F.coalesce("before", F.lit(0)))
    first = F.col("inside").isNull() & F.col("before").isNull()
    rows = ended.withColumn("end", end).withColumn("first", first).where(F.col("char_end") > F.col("end"))
    start = F.greatest(F.col("char_start"), F.col("end"))
    return rows.select(
        "doc_id", "chunk_id", "char_start", start.alias("fresh_start"), "char_end",
        (~F.col("first") & (F.col("char_start") > F.col("end"))).alias("gap"), F.substring("text", start - F.col("char_start") + 1, F.col("char_end")).alias("fresh"),
    )


def reconstruct(chunks: DataFrame, most_chars: int = 50_000_000) -> DataFrame:
    """``doc_id, part, text`` from the chunks; gaps become a blank line. A document whose end lies below ``most_chars`` is one
    row, part 0; a longer one, which no single value or task should hold, has a row for each stretch of so many characters,
    and its text is the parts joined in order."""
    rows = fresh_parts(chunks).withColumn("part", F.floor(F.col("fresh_start") / most_chars)).groupBy("doc_id", "part")
    parts = rows.agg(F.sort_array(F.collect_list(F.struct("fresh_start", "chunk_id", "gap", "fresh"))).alias("parts"))
    text = F.array_join(F.transform("parts", lambda p: F.concat(F.when(p["gap"], "\n\n").otherwise(""), p["fresh"])), "")
    return parts.select("doc_id", "part", text.alias("text"))
