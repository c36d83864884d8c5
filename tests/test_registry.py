"""Every core query against its SQL on the smallest tables."""

import glob
import math
import os
import re
from collections import Counter

import duckdb
import pytest

from lodestone.operators import details
from lodestone.plans import registry
from tests.test_chunking import plain_spans


@pytest.fixture(scope="module")
def sql(folder):
    con = duckdb.connect()
    for f in glob.glob(f"{folder}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 8)
    return v if isinstance(v, (int, str, bool, type(None))) else str(v)


def texts(sql):
    return dict(sql.execute("SELECT DISTINCT ON (chunk_id) chunk_id, text FROM chunks WHERE chunk_id IS NOT NULL AND text IS NOT NULL").fetchall())


def scanned(text):
    hits = sorted((m.start(), -m.end(), n, kind) for n, (kind, p) in enumerate(details.PATTERNS) for m in re.finditer(p, text))
    out = []
    for start, end, _, kind in hits:
        if not out or -end > max(e for _, e, _ in out):
            out.append((start, -end, kind))
    return out


def check_scan(rows, sql):
    want = Counter((i, *s) for i, t in texts(sql).items() for s in scanned(t))
    assert Counter((r["chunk_id"], r["span_start"], r["span_end"], r["kind"]) for r in rows) == want


def check_combined(rows, sql):
    own = texts(sql)
    want = Counter()
    said = {}
    for i, quote, kind in sql.execute("SELECT chunk_id, text, kind FROM pii_spans").fetchall():
        said.setdefault(i, []).append(((quote or "").strip(" "), kind or "other"))
    for i, t in own.items():
        hits = [(s, -e, 0, k) for s, e, k in scanned(t)]
        for quote, kind in said.get(i, []):
            hits += [(m.start(), -(m.start() + len(quote)), 1, kind) for m in re.finditer(f"(?={re.escape(quote)})", t)] if quote else []
        far = -1
        for start, end, _, kind in sorted(hits):
            if -end > far:
                far = -end
                want[i, start, far] += 1
    assert Counter((r["chunk_id"], r["span_start"], r["span_end"]) for r in rows) == want


def check_chunks(rows, sql):
    docs = sql.execute("SELECT doc_id, text FROM documents WHERE text IS NOT NULL").fetchall()
    want = Counter((i, n, t[a:b], a, b) for i, t in docs for n, (a, b) in enumerate(plain_spans(t, 400, 0.15)))
    assert Counter((r["doc_id"], r["chunk_idx"], r["text"], r["char_start"], r["char_end"]) for r in rows) == want


def check_cache(rows, sql):
    """A cache of 20 entries and a day for each kind of event, step by step."""
    want = {}
    by = {}
    for kind, user, ts in sql.execute("SELECT event_type, user_id, ts FROM events WHERE ts IS NOT NULL ORDER BY event_type, ts, event_id").fetchall():
        by.setdefault(kind, []).append((str(user), ts.timestamp()))
    for kind, asked in by.items():
        kept, hits = {}, 0
        for key, at in asked:
            expires = kept.pop(key, None)
            if expires is not None and expires >= at:
                hits += 1
                kept[key] = expires
            else:
                kept[key] = at + 86_400.0
                if len(kept) > 20:
                    del kept[next(iter(kept))]
        want[kind] = (hits, len(asked) - hits, len(kept))
    assert {r["shard"]: (r["hits"], r["misses"], r["size"]) for r in rows} == want


def check_answers(rows, sql):
    asked = {i for (i,) in sql.execute("SELECT DISTINCT turn_id FROM conversation_turns WHERE turn_id % 100 = 0 AND content IS NOT NULL").fetchall()}
    assert {r["qid"] for r in rows} == asked and len(rows) == len(asked)
    for r in rows:
        assert r["answer"] and (r["pipeline"] == "cached" or (r["answer"] == "NOT_FOUND") == (not r["sources"])), r
        assert [s["source_no"] for s in r["sources"] or []] == list(range(1, len(r["sources"] or []) + 1))


def check_summaries(rows, sql):
    want = {i: bool(t and t.strip()) for i, t in sql.execute("SELECT doc_id, text FROM documents").fetchall()}
    assert {r["doc_id"]: r["summary"] is not None for r in rows} == want and len(rows) == len(want)


#: Queries that SQL can't express, with their checks.
CHECKED = {
    "pii_scan": check_scan, "pii_combined": check_combined, "chunk_documents": check_chunks, "cache_lru_replay": check_cache, "answer_one_pass": check_answers, "answer_by_parts": check_answers,
    "answer_with_memory": check_answers, "document_summaries": check_summaries,
}


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, folder, sql, name):
    df = registry.QUERIES[name](spark, folder)
    rows = df.collect()
    if name not in registry.SQL:
        assert rows and name in CHECKED, name
        CHECKED[name](rows, sql)
        return
    result = sql.execute(registry.SQL[name])
    names = [c[0] for c in result.description]
    assert sorted(names) == sorted(df.columns)
    want = Counter(tuple(plain(dict(zip(names, r))[c]) for c in sorted(names)) for r in result.fetchall())
    assert Counter(tuple(plain(r[c]) for c in sorted(names)) for r in rows) == want
