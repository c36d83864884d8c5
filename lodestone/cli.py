"""``python -m lodestone.cli COMMAND``: the store's operators from a shell. Texts are a file's, a literal, or - for stdin."""

from __future__ import annotations

import argparse
import json
import os
import sys
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.operators import access, details, reminders
from lodestone.operators.chunking import reconstruct
from lodestone.plans import answer, intake
from lodestone.plans.model import Model, build_model
from lodestone.settings import Settings, load_settings
from lodestone.sources.store import Store
from lodestone.sources.tables import cut
from lodestone.streaming import jobs


def read_text(given: str) -> str:
    if given == "-":
        return sys.stdin.read()
    if os.path.isfile(given):
        with open(given, encoding="utf-8", errors="replace") as f:
            return f.read()
    return given


def _one(store: Store, text: str, name: str = "text", key: str = "qid") -> DataFrame:
    return store.spark.createDataFrame([(1, text)], f"{key} long, {name} string")


def _rows(df: DataFrame) -> Iterator[dict]:
    """All rows, fetched part by part as they are printed."""
    return (r.asDict(recursive=True) for r in df.toLocalIterator())


def status(store: Store, *_) -> dict:
    docs = store.table("documents")
    return {
        "generation": store.generation, "documents": docs.count(), "failed": docs.where("status = 'error'").count(), "chunks": store.table("chunks").count(),
        "pending_reminders": store.table("reminders").where("status = 'pending'").count(),
    }


def ask(store: Store, args, model: Model, settings: Settings) -> Iterator[dict]:
    asked, chunks, docs = _one(store, args.question, "question"), store.table("chunks"), store.table("documents")
    if args.plain:
        return _rows(answer.answer_single(asked, chunks, docs, model, settings, vectors=chunks.select("chunk_id", "embedding", "norm"), index=store.table("postings")))
    now = F.current_timestamp().cast("timestamp_ntz")
    made, turns, cache = answer.answer_remembered(asked, chunks, docs, store.table("conversation_turns"), store.table("semantic_memory"), store.table("answers"), now, store.meta("content", 0), model, settings, store.table("facts"), chunks.select("chunk_id", "embedding", "norm"), store.table("postings"))
    made = cut(made)
    store.commit({"conversation_turns": turns, "answers": cache})
    return _rows(made)


def summarize(store: Store, args, model: Model, settings: Settings) -> Iterator[dict]:
    if all(x.isdigit() for x in args.what):
        ids = [int(x) for x in args.what]
        texts = reconstruct(store.table("chunks").where(F.col("doc_id").isin(ids)))
        rows = texts.join(store.table("documents").select("doc_id", "filename"), "doc_id").select("doc_id", "filename", "text")
        return _rows(answer.summarize_together(rows, args.mode, model, settings.direct_summary_tokens))
    return _rows(answer.summarize(_one(store, read_text(args.what[0]), key="doc_id"), args.mode, model, limit_tokens=settings.direct_summary_tokens))


def find_details(store: Store, args, model: Model, *_) -> Iterator[dict]:
    text, said = _one(store, read_text(args.text), key="chunk_id"), None
    if args.model:
        said = answer.ask(text.select(F.col("chunk_id").alias("qid"), F.col("text").alias("prompt")), model, "FIND personal details, quoted exactly, as JSON.", as_json=True).withColumnRenamed("qid", "chunk_id")
    return _rows(details.combined(text, said).drop("chunk_id"))


def actions(store: Store, args, model: Model, *_) -> Iterator[dict]:
    said = answer.ask(_one(store, read_text(args.text), "prompt"), model, "LIST the action items that the text states, as JSON.", as_json=True)
    return _rows(details.actions(said).drop("qid"))


def remind(store: Store, args, model: Model, *_) -> Iterator[dict]:
    parsed = cut(answer.remind(_one(store, args.text).withColumn("now", F.date_trunc("second", F.current_timestamp()).cast("timestamp_ntz")), model))
    row = parsed.first()
    if row["error"]:
        raise ValueError(row["error"])
    known = store.table("reminders")
    store.commit({"reminders": reminders.add(known, parsed)})
    return iter([{"title": row["title"], "due_at": row["due_at"]}])


def list_reminders(store: Store, args, *_) -> Iterator[dict]:
    if args.done is not None:
        change = store.spark.createDataFrame([(args.done, "done")], "reminder_id long, status string")
        store.commit({"reminders": reminders.set_status(store.table("reminders"), change)})
    return _rows(reminders.open_reminders(store.table("reminders")))


def documents(store: Store, *_) -> Iterator[dict]:
    counts = store.table("chunks").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))
    known = access.resolve(store.table("documents"), store.table("folder_permissions"))
    return _rows(known.join(counts, "doc_id", "left").select("doc_id", "filename", "path", "status", "access_level", F.coalesce("n", F.lit(0)).alias("chunk_count")).orderBy("filename"))


def folders(store: Store, args, *_) -> Iterator[dict]:
    if args.set:
        path, level = args.set
        change = store.spark.createDataFrame([(os.path.abspath(path), level)], "path string, access_level string").withColumn("changed_at", F.current_timestamp().cast("timestamp_ntz"))
        intake.set_access(store, change)
    if args.remove is not None:
        store.commit({"folder_permissions": access.remove_folder(store.table("folder_permissions"), args.remove)})
    return _rows(access.folder_counts(store.table("documents"), store.table("folder_permissions")).orderBy("path"))


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="lodestone", description=__doc__)
    top.add_argument("--settings")
    top.add_argument("--model", dest="model_kind", default="offline", choices=("offline", "none"))
    sub = top.add_subparsers(dest="command", required=True)
    sub.add_parser("status").set_defaults(run=status)
    sub.add_parser("documents").set_defaults(run=documents)
    p = sub.add_parser("ingest")
    p.add_argument("paths", nargs="+")
    p.add_argument("--force", action="store_true")
    p.set_defaults(run=lambda store, a, m, s: intake.ingest_paths(store, [os.path.abspath(x) for x in a.paths], m, s, force=a.force))
    p = sub.add_parser("watch")
    p.add_argument("paths", nargs="+")
    p.add_argument("--seconds", type=float, default=60)
    p.set_defaults(run=lambda store, a, m, s: jobs.watch(store, [os.path.abspath(x) for x in a.paths], a.seconds, model=m, settings=s).awaitTermination())
    p = sub.add_parser("ask")
    p.add_argument("question")
    p.add_argument("--plain", action="store_true", help="one pass, never in parts")
    p.set_defaults(run=ask)
    p = sub.add_parser("summarize")
    p.add_argument("what", nargs="+", help="one to three document ids, or a text")
    p.add_argument("--mode", default="paragraph", choices=sorted(answer.SUMMARY))
    p.set_defaults(run=summarize)
    p = sub.add_parser("details")
    p.add_argument("text")
    p.add_argument("--model", action="store_true")
    p.set_defaults(run=find_details)
    sub.add_parser("models").set_defaults(run=lambda store, a, m, s: {"up": m.is_up(), "models": m.list_models() if m.is_up() else [], "missing": m.missing_models()})
    sub.add_parser("vacuum").set_defaults(run=lambda store, a, m, s: {"removed": store.vacuum()})
    sub.add_parser("truncate").set_defaults(run=lambda store, a, m, s: {"generation": store.truncate("documents", "chunks", "postings")})
    p = sub.add_parser("actions")
    p.add_argument("text")
    p.set_defaults(run=actions)
    p = sub.add_parser("remind")
    p.add_argument("text")
    p.set_defaults(run=remind)
    p = sub.add_parser("reminders")
    p.add_argument("--done", type=int)
    p.set_defaults(run=list_reminders)
    p = sub.add_parser("folders")
    p.add_argument("--set", nargs=2, metavar=("PATH", "LEVEL"))
    p.add_argument("--remove", type=int)
    p.set_defaults(run=folders)
    return top


def main(args: list[str] | None = None, spark: SparkSession | None = None) -> int:
    given = parser().parse_args(args)
    settings = load_settings(given.settings)
    spark = spark or SparkSession.builder.appName("lodestone").getOrCreate()
    try:
        made = given.run(Store(spark, os.path.abspath(settings.data_dir)), given, build_model(given.model_kind), settings)
        for row in [made] if isinstance(made, dict) else made:
            print(json.dumps(row, default=str, ensure_ascii=False))
    except (ValueError, KeyError, PermissionError) as e:
        print(f"error: {e}", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
