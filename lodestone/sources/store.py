"""A store of snapshots: the tables of a generation are Parquet folders, and a small file a generation names them."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMAS = {
    "documents": "doc_id long, path string, filename string, content_hash string, mtime double, size long, status string, error string, ingested_at timestamp_ntz",
    "chunks": "chunk_id long, doc_id long, chunk_idx int, text string, char_start int, char_end int, page int, embedding array<double>, norm double",
    "postings": "doc_id long, term string, chunk_id long, dl long, positions array<int>",
    "answers": "question string, answer string, sources array<struct<source_no:long,filename:string,path:string,page:int,chunk_idx:int>>, generation long, expires_at timestamp_ntz, used_seq long",
    "reminders": "reminder_id long, title string, due_at timestamp_ntz, created_at timestamp_ntz, status string, source_text string",
    "conversation_turns": "turn_id long, role string, content string, created_at timestamp_ntz",
    "semantic_memory": "item_id long, text string, source string, importance double, tags array<string>, created_at timestamp_ntz",
    "entities": "name_key string, name string, entity_type string, description string, created_seq long, updated_seq long",
    "facts": "fact_id long, subject string, predicate string, object string, confidence double, source string",
    "folder_permissions": "folder_id long, path string, access_level string, created_at timestamp_ntz, updated_at timestamp_ntz",
}


#: Tables kept in buckets of a key, of which a change writes only those that it touches.
BUCKETED = {"chunks": "doc_id", "postings": "doc_id"}
#: Columns by which a file's rows are sorted, so that a read skips row groups.
SORTED = {"postings": ["term", "chunk_id"]}
BUCKETS = 256


def bucket(key: str) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(BUCKETS)).cast("int")


class Store:
    """Tables under ``root`` (any Hadoop path). One writer at a time.

    A commit writes the new folders of the next generation, then its state as a file under another name, which is renamed to
    ``state/<generation>.json`` last. Nothing is deleted or replaced before, so a job that dies at any step leaves the last
    complete generation in force; what it wrote is written over by the next commit. ``vacuum`` removes what no kept
    generation names.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _names(self, folder: str) -> list[str]:
        at = self._path(f"{self.root}/{folder}")
        return [f.getPath().getName() for f in self._fs.listStatus(at)] if self._fs.exists(at) else []

    def generations(self) -> list[int]:
        """Numbers of the complete generations that are kept, in order."""
        return sorted(int(n[:-5]) for n in self._names("state") if n.endswith(".json") and n[:-5].isdigit())

    def _state(self, number: int | None = None) -> dict:
        if number is None:
            known = self.generations()
            if not known:
                return {"generation": 0, "tables": {}, "meta": {}}
            number = known[-1]
        lines = self.spark.read.option("wholetext", True).text(f"{self.root}/state/{number}.json").collect()  # one row
        return json.loads(lines[0][0])

    @property
    def generation(self) -> int:
        known = self.generations()
        return known[-1] if known else 0

    def meta(self, key: str, default=None):
        return self._state()["meta"].get(key, default)

    def _read(self, name: str, paths: list[str]) -> DataFrame:
        return self.spark.read.schema(SCHEMAS[name]).parquet(*paths) if paths else self.spark.createDataFrame([], SCHEMAS[name])

    def table(self, name: str) -> DataFrame:
        """The current rows of a table; an empty one if it was never written."""
        return self._read(name, list(self._state()["tables"].get(name, {}).values()))

    def _write(self, name: str, df: DataFrame, number: int) -> dict[str, str]:
        """Writes a table and returns its folders, by bucket if it has any."""
        at = f"{self.root}/gen={number}/{name}"
        if name not in BUCKETED:
            df.write.mode("overwrite").parquet(at)
            return {"": at}
        df.withColumn("bucket", bucket(BUCKETED[name])).hint("rebalance", "bucket").sortWithinPartitions("bucket", *SORTED.get(name, [])).write.mode("overwrite").partitionBy("bucket").parquet(at)
        return {n.partition("=")[2]: f"{at}/{n}" for n in self._names(f"gen={number}/{name}") if n.startswith("bucket=")}

    def commit(self, tables: dict[str, DataFrame] | None = None, meta: dict | None = None, changes: dict[str, tuple[DataFrame, DataFrame]] | None = None) -> int:
        """Writes whole ``tables`` and, of bucketed tables, ``changes``: the keys that go (a column of that name) and the rows
        that come; only buckets with any of them are read and written."""
        state = self._state()
        number = state["generation"] + 1
        for name, df in (tables or {}).items():
            state["tables"][name] = self._write(name, df, number)
        for name, (gone, come) in (changes or {}).items():
            key, old = BUCKETED[name], state["tables"].get(name, {})
            touched = {str(r[0]) for r in gone.select(bucket(key)).union(come.select(bucket(key))).distinct().collect()}  # at most BUCKETS rows
            if touched:
                kept = self._read(name, [p for b, p in old.items() if b in touched]).join(gone.select(key).distinct(), key, "left_anti")
                new = self._write(name, kept.select(come.columns).unionByName(come), number)
                state["tables"][name] = {b: p for b, p in old.items() if b not in touched} | new
        state |= {"generation": number, "meta": state["meta"] | (meta or {})}
        temp, final = self._path(f"{self.root}/state/{number}.new"), self._path(f"{self.root}/state/{number}.json")
        out = self._fs.create(temp, True)
        out.write(bytearray(json.dumps(state).encode()))
        out.close()
        if not self._fs.rename(temp, final):
            raise OSError(f"generation {number} was committed by another writer")
        return number

    def vacuum(self, keep: int = 2) -> list[str]:
        """Removes the states of all but the last ``keep`` generations and the folders that no kept one names; returns these.
        Jobs that still read an older generation fail."""
        known = self.generations()
        for number in known[:-keep]:
            self._fs.delete(self._path(f"{self.root}/state/{number}.json"), False)
        used = {p for n in known[-keep:] for t in self._state(n)["tables"].values() for p in t.values()}
        gone = []
        for gen in [n for n in self._names("") if n.startswith("gen=")]:
            for name in self._names(gen):
                own = f"{self.root}/{gen}/{name}"
                parts = [f"{own}/{n}" for n in self._names(f"{gen}/{name}") if n.startswith("bucket=")] or [own]
                dead = [p for p in parts if p not in used]
                for p in [own] if len(dead) == len(parts) else dead:
                    self._fs.delete(self._path(p), True)
                    gone.append(p)
            if not self._names(gen):
                self._fs.delete(self._path(f"{self.root}/{gen}"), True)
        return gone

    def truncate(self, *names: str) -> int:
        return self.commit({n: self.spark.createDataFrame([], SCHEMAS[n]) for n in names})
