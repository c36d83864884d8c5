"""Answering many questions in one job: retrieve, pack, ask the model, resolve its citations; and summaries."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions.text import NOT_FOUND, approx_tokens, is_not_found, needs_parts
from lodestone.operators import context, memory, reminders, search
from lodestone.operators.chunking import chunk_spans
from lodestone.plans.model import Model, ModelError, OfflineModel
from lodestone.settings import Settings
from lodestone.sources.tables import cut, numbered, release, spread

ANSWER = f"ANSWER the question from the numbered excerpts only. Cite them as [n]. If they hold no answer, reply exactly {NOT_FOUND}."
SPLIT = "SPLIT the question into at most four parts, each with a search query and key terms, as JSON."
SCORE = "SCORE each numbered excerpt for the questions, 0 to 1, as JSON."
CHECK = "CHECK whether the answer follows from the excerpts and is complete, as JSON."
PART = "PART the reminder request into title and when_phrase, quoted exactly, as JSON."
SUMMARY = {
    "paragraph": "SUMMARISE the text in one paragraph.",
    "bullets": "SUMMARISE the text as bullet points.",
    "detailed": "SUMMARISE the text in detail, section by section.",
}


def ask(prompts: DataFrame, model: Model, system: str, as_json: bool = False, out: str = "answer") -> DataFrame:
    """``prompts`` (``qid, prompt``) with the model's answer, null where it failed; JSON answers as text."""
    import json

    kind = prompts.schema["qid"].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            made = []
            for prompt in pdf["prompt"]:
                try:
                    made.append(json.dumps(model.chat_json(system, prompt)) if as_json else model.chat(system, prompt))
                except ModelError:
                    made.append(None)
            yield pd.DataFrame({"qid": pdf["qid"], out: made})

    return prompts.select("qid", "prompt").mapInPandas(run, f"qid {kind}, {out} string")


def embed(rows: DataFrame, key: str, text: str, model: Model, prefix: str = "") -> DataFrame:
    """``key, embedding`` by the model, a call for each batch of rows. Null texts have none."""
    kind = rows.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({key: pdf[key], "embedding": model.embed([prefix + t for t in pdf["_text"]])})

    return rows.where(F.col(text).isNotNull()).select(key, F.col(text).alias("_text")).mapInPandas(run, f"`{key}` {kind}, embedding array<double>")


def _ask_and_check(prompts: DataFrame, model: Model, verify: bool) -> DataFrame:
    """``qid, answer, check`` of ``_prompts``: the answer as by ``ask``, and the model's JSON on it, null without ``verify`` or an
    answer. Both are asked where the excerpts are, which aren't gathered twice."""
    import json

    kind = prompts.schema["qid"].dataType.simpleString()

    def said(f, *args) -> str | dict | None:
        try:
            return f(*args)
        except ModelError:
            return None

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            answers, checks = [], []
            for question, shown, prompt in zip(pdf["question"], pdf["context"], pdf["prompt"], strict=True):
                answers.append(said(model.chat, ANSWER, prompt))
                made = said(model.chat_json, CHECK, f"Question: {question}\n\nAnswer given: {answers[-1]}\n\nExcerpts used:\n{shown}") if verify and answers[-1] is not None else None
                checks.append(None if made is None else json.dumps(made))
            yield pd.DataFrame({"qid": pdf["qid"], "answer": answers, "check": checks})

    return prompts.select("qid", "question", "context", "prompt").mapInPandas(run, f"qid {kind}, answer string, check string")


def _with_texts(included: DataFrame, chunks: DataFrame) -> DataFrame:
    """Included rows with the texts of their chunks, where they have none of their own (a ``fact``)."""
    rows = included.join(chunks.select("chunk_id", "text"), "chunk_id", "left")
    return rows.withColumn("text", F.coalesce("fact", "text")) if "fact" in included.columns else rows


def _prompts(questions: DataFrame, included: DataFrame, extra: DataFrame | None) -> DataFrame:
    base = questions.join(context.prompt_blocks(included), "qid")
    if extra is not None:
        base = base.join(extra.select("qid", F.col("context").alias("_extra")), "qid", "left")
    else:
        base = base.withColumn("_extra", F.lit(None).cast("string"))
    before = F.when(F.length(F.coalesce("_extra", F.lit(""))) > 0, F.concat("_extra", F.lit("\n\n"))).otherwise("")
    return base.select("qid", "question", "context", F.concat(before, F.lit("Context excerpts:\n\n"), "context", F.lit("\n\nQuestion: "), "question").alias("prompt"))


def _answered(questions: DataFrame, included: DataFrame, said: DataFrame, pipeline: str) -> DataFrame:
    """``qid, answer, sources, pipeline``; questions without excerpts were never asked, a failed call is not found."""
    answers = said.select("qid", F.when(F.col("answer").isNull() | is_not_found(F.col("answer")), NOT_FOUND).otherwise(F.col("answer")).alias("answer"))
    sources = context.citations(included, answers.where(F.col("answer") != NOT_FOUND))
    listed = sources.groupBy("qid").agg(F.sort_array(F.collect_list(F.struct("source_no", "filename", "path", "page", "chunk_idx"))).alias("sources"))
    base = questions.select("qid").join(answers, "qid", "left").join(listed, "qid", "left")
    return base.select("qid", F.coalesce("answer", F.lit(NOT_FOUND)).alias("answer"), "sources", F.lit(pipeline).alias("pipeline"))


def answer_single(questions: DataFrame, chunks: DataFrame, documents: DataFrame, model: Model | None = None, settings: Settings | None = None, extra: DataFrame | None = None, vectors: DataFrame | None = None, index: DataFrame | None = None) -> DataFrame:
    """One pass: hybrid search, packing, one call a question. ``questions`` has ``qid, question``, ``extra`` a context each."""
    model, s = model or OfflineModel(), settings or Settings()
    vectors = vectors if vectors is not None else cut(embed(chunks, "chunk_id", "text", model, model.document_prefix))
    asked = embed(questions, "qid", "question", model, model.query_prefix)
    found = search.hybrid(chunks, documents, questions, vectors, asked, s.vector_top_k, max(s.vector_top_k, s.keyword_top_k), index, texts=False)
    included = cut(context.pack(found, s.context_token_budget).select("qid", "place", "chunk_id", "filename", "path", "page", "chunk_idx"))
    del found, vectors
    release(chunks.sparkSession)
    said = cut(ask(_prompts(questions, _with_texts(included, chunks), extra), model, ANSWER))
    release(chunks.sparkSession)
    return _answered(questions, included, said, "fast")


def split_questions(questions: DataFrame, model: Model, settings: Settings) -> DataFrame:
    """``qid, sub, question, search_query, key_terms``: at most ``max_subqueries`` complete parts, the question itself if there
    are none or the model failed."""
    said = ask(questions.select("qid", F.col("question").alias("prompt")), model, SPLIT, as_json=True)
    return sub_queries(questions, said, settings)


def sub_queries(questions: DataFrame, said: DataFrame, settings: Settings | None = None) -> DataFrame:
    """As ``split_questions``, from the model's JSON ``qid, answer``."""
    s = settings or Settings()
    items = F.from_json("answer", "sub_queries array<struct<question string, search_query string, key_terms array<string>>>")["sub_queries"]
    rows = said.select("qid", F.posexplode(items).alias("sub", "i")).select("qid", "sub", F.trim("i.question").alias("question"), F.trim("i.search_query").alias("search_query"), F.slice(F.filter(F.transform(F.coalesce("i.key_terms", F.array().cast("array<string>")), lambda t: F.trim(t)), lambda t: F.length(t) > 0), 1, 5).alias("key_terms"))
    rows = rows.where("question <> '' and search_query <> ''").withColumn("sub", F.row_number().over(Window.partitionBy("qid").orderBy("sub"))).where(F.col("sub") <= s.max_subqueries)
    rest = questions.join(rows.select("qid").distinct(), "qid", "left_anti").select("qid", F.lit(1).alias("sub"), "question", F.col("question").alias("search_query"), F.array().cast("array<string>").alias("key_terms"))
    return rows.unionByName(rest)


def verdicts(said: DataFrame) -> DataFrame:
    """``qid, confidence, is_complete, gaps`` of the model's JSON: 0.5 and true if missing, clamped, up to five gaps that
    aren't blank; all null where the model failed."""
    v = F.from_json("answer", "confidence double, is_complete boolean, gaps array<string>")
    gaps = F.slice(F.filter(F.transform(F.coalesce(v["gaps"], F.array().cast("array<string>")), lambda g: F.trim(g)), lambda g: F.length(g) > 0), 1, 5)
    ok = F.col("answer").isNotNull()
    return said.select("qid", F.when(ok, F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(v["confidence"], F.lit(0.5))))).alias("confidence"), F.when(ok, F.coalesce(v["is_complete"], F.lit(True))).alias("is_complete"), F.when(ok, gaps).alias("gaps"))


def answer_in_parts(questions: DataFrame, chunks: DataFrame, documents: DataFrame, model: Model | None = None, settings: Settings | None = None, facts: DataFrame | None = None, extra: DataFrame | None = None, vectors: DataFrame | None = None, index: DataFrame | None = None) -> DataFrame:
    """The long way for questions that look as if they had parts, ``answer_single`` for the others.

    Parts are searched in one batch, their hits pooled, facts around their key terms added, all excerpts scored in one call
    a question, the best packed and answered, and the answer checked. ``qid, answer, sources, pipeline, confidence, checked,
    is_complete, gaps``: confidence is the mean score of the excerpts used, ``checked`` the model's own.
    """
    model, s = model or OfflineModel(), settings or Settings()
    vectors = vectors if vectors is not None else cut(embed(chunks, "chunk_id", "text", model, model.document_prefix))
    gated = cut(questions.select("qid", "question").withColumn("many", F.coalesce(needs_parts(F.col("question"), s), F.lit(False))))
    plain, many = gated.where("not many").drop("many"), gated.where("many").drop("many")
    fast = answer_single(plain, chunks, documents, model, s, extra, vectors, index)
    empty = [F.lit(None).cast(t).alias(c) for c, t in (("confidence", "double"), ("checked", "double"), ("is_complete", "boolean"), ("gaps", "array<string>"))]
    fast = fast.select("*", *empty)

    parts = cut(split_questions(many, model, s))
    key = F.concat_ws("/", F.col("qid").cast("string"), F.col("sub").cast("string"))
    subs = parts.select(key.alias("qid"), F.col("search_query").alias("question"))
    k = max(s.vector_top_k, s.keyword_top_k)
    asked = embed(subs, "qid", "question", model, model.query_prefix)
    hits = cut(search.fuse([search.cosine(vectors, asked, s.vector_top_k), search.bm25(chunks, subs, s.keyword_top_k, index)], k))
    back = parts.select(key.alias("_key"), F.col("qid").alias("_qid"), "sub")
    hits = hits.join(back, hits["qid"] == back["_key"]).select(F.col("_qid").alias("qid"), "sub", "chunk_id", "score", "rank")
    pool = search.merge_pools(hits, s.max_candidates)
    own = search.found(chunks, hits).select("chunk_id", "doc_id", "chunk_idx", "page", approx_tokens(F.coalesce("text", F.lit(""))).alias("tokens")).join(documents.select("doc_id", "filename", "path"), "doc_id")
    pool = pool.join(own, "chunk_id").select("qid", "place", "chunk_id", "score", "filename", "path", "page", "chunk_idx", "tokens", F.lit(None).cast("string").alias("fact"))
    if facts is not None:
        terms = parts.select("qid", F.explode("key_terms").alias("term"))
        known = memory.fact_candidates(facts, terms, s.related_limit, s.max_candidates)
        pool = pool.unionByName(known.select("qid", "place", "chunk_id", "score", F.lit("knowledge base").alias("filename"), F.lit("").alias("path"), F.lit(None).cast("int").alias("page"), F.lit(0).alias("chunk_idx"), approx_tokens(F.coalesce("text", F.lit(""))).alias("tokens"), F.coalesce("text", F.lit("")).alias("fact")))
    dense = F.row_number().over(Window.partitionBy("qid").orderBy("place")).cast("long")
    pool = cut(pool.withColumn("place", dense))
    del hits, vectors, asked
    release(chunks.sparkSession)

    line = F.concat(F.lit("["), "place", F.lit("] ("), "filename", F.lit(") "), F.substring(F.coalesce("text", F.lit("")), 1, s.excerpt_chars))
    starts = chunks.select("chunk_id", F.substring("text", 1, s.excerpt_chars).alias("text"))
    excerpts = _with_texts(pool, starts).groupBy("qid").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("place", line.alias("line")))), lambda x: x["line"]), "\n").alias("excerpts"))
    titles = parts.groupBy("qid").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("sub", F.concat(F.lit("- "), "question").alias("q")))), lambda x: x["q"]), "\n").alias("titles"))
    prompts = excerpts.join(titles, "qid").select("qid", F.concat(F.lit("Question(s):\n"), "titles", F.lit("\n\nExcerpts:\n"), "excerpts").alias("prompt"))
    said = cut(ask(prompts, model, SCORE, as_json=True))
    release(chunks.sparkSession)
    score = F.from_json("answer", "scores array<struct<index int, relevance double>>")["scores"]
    scores = said.select("qid", F.posexplode(score).alias("seq", "s")).select("qid", F.col("s.index").cast("long").alias("place"), F.col("s.relevance").alias("relevance"), "seq")
    good = search.filter_evidence(pool.select("qid", "place", "chunk_id", "score"), scores, s.relevance_threshold, s.evidence_top_n)
    failed = said.where("answer is null").select("qid")
    unscored = pool.join(failed, "qid", "left_semi").where(F.col("place") <= s.evidence_top_n).select("qid", F.col("place").alias("n"), "place", "chunk_id", "score", F.lit(None).cast("double").alias("relevance"))
    chosen = good.join(failed, "qid", "left_anti").unionByName(unscored)
    ranked = chosen.select("qid", "n", "place", "relevance").join(pool.drop("score"), ["qid", "place"]).drop("place").withColumnRenamed("n", "place")
    included = cut(context.pack(ranked, s.context_token_budget).drop("tokens", "cost", "spent"))
    answers = cut(_ask_and_check(_prompts(many, _with_texts(included, chunks), extra), model, s.verify))
    release(chunks.sparkSession)
    full = _answered(many, included, answers, "full").join(context.confidence(included), "qid", "left")
    if s.verify:
        found = verdicts(answers.select("qid", F.col("check").alias("answer"))).withColumnRenamed("confidence", "checked")
        full = full.join(found, "qid", "left")
    else:
        full = full.select("*", *empty[1:])
    return fast.unionByName(full.select(fast.columns))


def cached(questions: DataFrame, answers: DataFrame, now: Column, generation: int) -> DataFrame:
    """``qid, answer, sources`` of the questions that ``answers`` holds word by word, of this generation and not expired."""
    fresh = answers.where((F.col("generation") == generation) & (F.col("expires_at") >= now)).select("question", "answer", "sources")
    return questions.select("qid", "question").join(fresh, "question").select("qid", "answer", "sources")


def finalise_turns(questions: DataFrame, answered: DataFrame, turns: DataFrame, now: Column) -> DataFrame:
    """``turns`` with each question and its answer as two new ones under the next ids, in order of the questions' ids."""
    said = questions.join(answered.select("qid", "answer"), "qid")
    two = F.explode(F.array(F.struct(F.lit(0).alias("n"), F.lit("user").alias("role"), F.col("question").alias("content")), F.struct(F.lit(1).alias("n"), F.lit("assistant").alias("role"), F.col("answer").alias("content"))))
    top = turns.agg(F.coalesce(F.max("turn_id"), F.lit(0))).first()[0]
    rows = said.select("qid", two.alias("t")).select("qid", F.col("t.n").alias("n"), F.col("t.role").alias("role"), F.col("t.content").alias("content"), now.alias("created_at"))
    return turns.unionByName(numbered(rows, ["qid", "n"], top, "turn_id").select(turns.columns))


def finalise_cache(questions: DataFrame, answered: DataFrame, hits: DataFrame, answers: DataFrame, now: Column, generation: int, settings: Settings | None = None) -> DataFrame:
    """``answers`` with the new ones (also those not found), the used ones moved up, and of all the ``cache_max_size`` used last.
    A question asked twice is kept with the answer of its highest id."""
    s = settings or Settings()
    top = answers.agg(F.coalesce(F.max("used_seq"), F.lit(0))).first()[0]
    expires = now + F.make_dt_interval(secs=F.lit(s.cache_ttl_s))
    new = questions.join(answered.select("qid", "answer", "sources"), "qid").groupBy("question").agg(F.max_by("answer", "qid").alias("answer"), F.max_by("sources", "qid").alias("sources"), F.max("qid").alias("_by"))
    new = new.select("question", "answer", "sources", F.lit(generation).cast("long").alias("generation"), expires.alias("expires_at"), "_by")
    used = questions.join(hits.select("qid"), "qid").groupBy("question").agg(F.max("qid").alias("_by"))
    old = answers.join(new.select("question"), "question", "left_anti").join(used, "question", "left")
    moved = old.where("_by is not null").select(*[c for c in answers.columns if c != "used_seq"], "_by").unionByName(new.select(*[c for c in answers.columns if c != "used_seq"], "_by"))
    rows = old.where("_by is null").select(answers.columns).unionByName(numbered(moved, ["_by"], top, "used_seq").select(answers.columns))
    return rows.orderBy(F.desc("used_seq")).limit(s.cache_max_size)


def answer_remembered(questions: DataFrame, chunks: DataFrame, documents: DataFrame, turns: DataFrame, items: DataFrame, answers: DataFrame, now: Column, generation: int, model: Model | None = None, settings: Settings | None = None, facts: DataFrame | None = None, vectors: DataFrame | None = None, index: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Questions with memory: answers still in the cache are given again, the others are answered with what is remembered before
    the excerpts. Returns the answers (``pipeline`` is ``cached``, ``fast`` or ``full``), and turns and cache as they are then."""
    s = settings or Settings()
    asked = cut(questions.select("qid", "question"))
    hits = cut(cached(asked, answers, now, generation))
    rest = cut(asked.join(hits.select("qid"), "qid", "left_anti"))
    recent = memory.newest(turns, s.memory_max_turns).collect()  # as many as the memory holds
    spoken = F.array(*[F.struct(F.lit(r["turn_id"]).alias("seq"), F.lit(r["role"]).alias("role"), F.lit(r["content"]).alias("content")) for r in recent]) if recent else None
    said = rest.select("qid", F.explode(spoken).alias("t")).select("qid", "t.seq", "t.role", "t.content") if spoken is not None else rest.select("qid", F.lit(0).alias("seq"), F.lit("").alias("role"), F.lit("").alias("content")).where("false")
    known = memory.search(items, rest, s.memory_top_k_facts).join(items.select("item_id", "text"), "item_id")
    extra = context.bounded_memory(said, known, rest, s.memory_context_budget, s.memory_top_k_facts)
    made = cut(answer_in_parts(rest, chunks, documents, model, s, facts, extra, vectors, index))
    none = [F.lit(None).cast(made.schema[c].dataType).alias(c) for c in made.columns if c not in ("qid", "answer", "sources", "pipeline")]
    again = hits.select("qid", "answer", "sources", F.lit("cached").alias("pipeline"), *none)
    return made.unionByName(again.select(made.columns)), finalise_turns(rest, made, turns, now), finalise_cache(rest, made, hits.join(asked, "qid").select("qid"), answers, now, generation, s)


def remind(rows: DataFrame, model: Model | None = None) -> DataFrame:
    """``rows`` (``qid, text, now``) read by ``reminders.parse``; where that fails the model is asked for title and phrase, whose
    date is still resolved by the grammar."""
    parsed = cut(reminders.parse(rows))
    if model is None:
        return parsed
    asked = parsed.where("error is not null and text is not null").select("qid", F.concat(F.lit("Reminder request: "), "text").alias("prompt"))
    return reminders.parse_said(parsed, ask(asked, model, PART, as_json=True), "qid")


def summarize(rows: DataFrame, mode: str = "paragraph", model: Model | None = None, key: str = "doc_id", limit_tokens: int = 5000) -> DataFrame:
    """``key, summary`` of each ``text``: in one call if it is short, else a paragraph of each piece and then one of those. The
    pieces of a long text are asked for side by side. Keys must be distinct.

    Null and blank texts have a null summary, as has a text whose model calls fail."""
    if mode not in SUMMARY:
        raise ValueError(f"mode must be one of {sorted(SUMMARY)}")
    model = model or OfflineModel()
    kind = rows.schema[key].dataType.simpleString()

    def cut_up(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for own, text in zip(pdf[key], pdf["text"], strict=True):
                if not text or not text.strip():
                    continue
                if len(text) // 4 <= limit_tokens:
                    out.append((own, 1, 1, f"{SUMMARY[mode]}\n\nText:\n\n{text}"))
                    continue
                spans = chunk_spans(text, limit_tokens, 0.02)
                out += [(own, i, len(spans), f"{SUMMARY['paragraph']}\n\nText (part {i} of {len(spans)}):\n\n{text[a:b]}") for i, (a, b) in enumerate(spans, 1)]
            yield pd.DataFrame(out, columns=[key, "part", "parts", "prompt"])

    pieces = spread(cut(rows.select(key, "text").mapInPandas(cut_up, f"`{key}` {kind}, part int, parts int, prompt string")))
    at = F.concat_ws("/", F.col(key).cast("string"), "part")
    said = cut(pieces.select(key, "part", "parts", at.alias("qid")).join(ask(pieces.select(at.alias("qid"), "prompt"), model, "SUMMARY"), "qid"))
    short = said.where("parts = 1").select(key, F.col("answer").alias("summary"))
    ordered = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("part", "answer"))), lambda x: x["answer"]), "\n\n")
    joined = said.where("parts > 1").groupBy(key).agg(F.count("answer").alias("n"), F.max("parts").alias("parts"), ordered.alias("text")).where("n = parts")
    prompts = joined.select(F.col(key).alias("qid"), F.concat(F.lit(f"Partial summaries of one document, in order. {SUMMARY[mode]}\n\nPartial summaries:\n\n"), "text").alias("prompt"))
    long = ask(prompts, model, "SUMMARY").select(F.col("qid").alias(key), F.col("answer").alias("summary"))
    return rows.select(key).join(short.unionByName(long), key, "left")


def summarize_together(documents: DataFrame, mode: str = "paragraph", model: Model | None = None, limit_tokens: int = 5000) -> DataFrame:
    """One summary of one to three documents ``doc_id, filename, text``: each first in a paragraph of its own."""
    n = documents.limit(4).count()
    if not 1 <= n <= 3:
        raise ValueError("one to three documents can be summarised together")
    if mode not in SUMMARY:
        raise ValueError(f"mode must be one of {sorted(SUMMARY)}")
    if n == 1:
        return summarize(documents, mode, model, limit_tokens=limit_tokens).select("summary")
    each = summarize(documents, "paragraph", model, limit_tokens=limit_tokens).join(documents.select("doc_id", "filename"), "doc_id")
    block = F.concat(F.lit("## "), "filename", F.lit("\n"), F.coalesce("summary", F.lit("")))
    joined = each.groupBy(F.lit(1).cast("long").alias("doc_id")).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("doc_id", block.alias("b")))), lambda x: x["b"]), "\n\n").alias("text"))
    return summarize(joined, mode, model, limit_tokens=limit_tokens).select("summary")
