"""From ranked chunks to the model's context, and from its answer back to sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions.text import approx_tokens, citation_marks, context_block


def pack(ranked: DataFrame, budget: int = 3000, extra: int = 20) -> DataFrame:
    """The first rows of each question whose estimated tokens (and ``extra`` each) fit into ``budget``; the first row always.
    ``ranked`` has ``qid, place, text``, or ``tokens`` as ``approx_tokens`` has them instead of the text; adds ``cost`` and
    ``spent``. Stops at the first row that doesn't fit."""
    order = Window.partitionBy("qid").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    tokens = F.col("tokens") if "tokens" in ranked.columns else approx_tokens(F.coalesce("text", F.lit("")))
    costed = ranked.withColumn("cost", tokens + extra).withColumn("spent", F.sum("cost").over(order))
    costed = costed.withColumn("_n", F.row_number().over(Window.partitionBy("qid").orderBy("place")))
    return costed.where((F.col("spent") <= budget) | (F.col("_n") == 1)).drop("_n")


def prompt_blocks(included: DataFrame) -> DataFrame:
    """``qid, context``: the blocks of a question's included chunks, blank lines between."""
    block = context_block(F.col("place"), F.col("filename"), F.col("page"), F.col("chunk_idx"), F.coalesce("text", F.lit("")))
    rows = included.select("qid", F.struct("place", block.alias("block")).alias("b"))
    return rows.groupBy("qid").agg(F.array_join(F.transform(F.sort_array(F.collect_list("b")), lambda b: b["block"]), "\n\n").alias("context"))


def citations(included: DataFrame, answers: DataFrame) -> DataFrame:
    """The sources of each answer: the chunks its marks name, or all if no mark is valid; of those of one path and page the
    first. ``included`` has ``qid, place, filename, path, page, chunk_idx`` with places 1.., ``answers`` ``qid, answer``."""
    most = included.groupBy("qid").agg(F.max("place").alias("most"))
    marks = answers.join(most, "qid").select("qid", citation_marks(F.col("answer"), F.col("most")).alias("marks"))
    used = included.join(marks, "qid").where((F.size("marks") <= 0) | F.array_contains("marks", F.col("place").cast("int")))
    first = Window.partitionBy("qid", "path", "page").orderBy("place")
    kept = used.withColumn("n", F.row_number().over(first)).where("n = 1")
    order = Window.partitionBy("qid").orderBy("place")
    return kept.select("qid", F.row_number().over(order).cast("long").alias("source_no"), "filename", "path", "page", "chunk_idx")


def confidence(included: DataFrame) -> DataFrame:
    """``qid, confidence``: mean of the known relevances of a question's included chunks, null if none is known."""
    return included.groupBy("qid").agg(F.round(F.avg("relevance"), 6).alias("confidence"))


def bounded_memory(turns: DataFrame, facts: DataFrame, questions: DataFrame, budget: int = 400, top_facts: int = 5, reserve: float = 0.3) -> DataFrame:
    """``qid, context`` from recent turns and remembered facts within a token budget.

    ``turns`` has ``qid, seq, role, content``: newest first they are taken while they fit into the budget without its
    reserve, the newest always. ``facts`` has ``qid, place, text``: the first ``top_facts`` in order while they fit into what
    the turns left, the first always if anything is left. Shown oldest turn first; a question without either has ''.
    """
    spoken = turns.select("qid", "seq", F.concat("role", F.lit(": "), F.coalesce("content", F.lit(""))).alias("line"))
    newest = Window.partitionBy("qid").orderBy(F.desc("seq"))
    spoken = spoken.withColumn("n", F.row_number().over(newest)).withColumn("spent", F.sum(approx_tokens(F.col("line"))).over(newest.rowsBetween(Window.unboundedPreceding, 0)))
    kept = spoken.where((F.col("spent") <= budget - int(budget * reserve)) | (F.col("n") == 1))
    said = kept.groupBy("qid").agg(F.max("spent").alias("used"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("seq", "line"))), lambda x: x["line"]), "\n").alias("said"))
    base = questions.select("qid").distinct().join(said, "qid", "left").withColumn("left", F.lit(budget) - F.coalesce("used", F.lit(0)))
    known = facts.where(F.col("place") <= top_facts).select("qid", "place", F.concat(F.lit("known: "), "text").alias("line")).join(base.select("qid", "left"), "qid").where(F.col("left") > 0)
    order = Window.partitionBy("qid").orderBy("place")
    known = known.withColumn("n", F.row_number().over(order)).withColumn("spent", F.sum(approx_tokens(F.col("line"))).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    known = known.where((F.col("spent") <= F.col("left")) | (F.col("n") == 1)).groupBy("qid").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("place", "line"))), lambda x: x["line"]), "\n").alias("known"))
    sections = F.array_compact(F.array(F.when(F.col("said").isNotNull(), F.concat(F.lit("Recent conversation:\n"), "said")), F.when(F.col("known").isNotNull(), F.concat(F.lit("Remembered facts:\n"), "known"))))
    return base.join(known, "qid", "left").select("qid", F.array_join(sections, "\n\n").alias("context"))
