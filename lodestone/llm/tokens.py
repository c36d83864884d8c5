"""Problem 6: the corpus as ids of a public tokenizer."""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.bpe import Decoder, encoder
from lodestone.sources.tables import spread

VOCABULARY = os.path.join(os.environ.get("TOKENIZERS", "/opt/tokenizers"), "byte_bpe_50k.tiktoken")


def encode_column(df: DataFrame, text: str = "text", out: str = "ids", vocabulary: str = VOCABULARY, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns ``keep`` and ``out``, the ids of column ``text`` without special tokens.

    Null and empty texts have the empty list. The strings of special tokens are ordinary text. Rows, also repeated ones and
    rows with null keys, stay as they are; other columns are not read. One pass, no shuffle.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packed = encoder(vocabulary).packed
        for batch in batches:
            parts = [packed(t) for t in batch.column(len(keep)).to_pylist()]
            ends = np.zeros(len(parts) + 1, np.int32)
            np.cumsum([len(p) // 4 for p in parts], out=ends[1:])
            ids = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(parts), np.int32)))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], ids], [*keep, out])

    source = spread(df.select(*keep, F.col(text).alias("_text")))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields[:-1])
    return source.mapInArrow(run, f"{kinds}, `{out}` array<int>")


def count_tokens(df: DataFrame, text: str = "text", vocabulary: str = VOCABULARY, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns ``keep`` and ``tokens``, the number of ids; 0 for null and empty texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packed = encoder(vocabulary).packed
        for batch in batches:
            n = pa.array([len(packed(t)) // 4 for t in batch.column(len(keep)).to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], n], [*keep, "tokens"])

    source = spread(df.select(*keep, F.col(text).alias("_text")))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields[:-1])
    return source.mapInArrow(run, f"{kinds}, tokens long")


def decode_column(df: DataFrame, ids: str = "ids", out: str = "text", vocabulary: str = VOCABULARY, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns ``keep`` and ``out``, the text of column ``ids``; empty and null lists give the empty text, bytes that are no
    UTF-8 the replacement character."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bytes_of = encoder(vocabulary).machine.bytes_of
        for batch in batches:
            texts = []
            for own in batch.column(len(keep)).to_pylist():
                decoder = Decoder(bytes_of)
                texts.append(decoder.feed(own or ()) + decoder.close())
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(texts, pa.string())], [*keep, out])

    source = df.select(*keep, F.col(ids).alias("_ids"))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields[:-1])
    return source.mapInArrow(run, f"{kinds}, `{out}` string")
