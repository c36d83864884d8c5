"""Problem 2: groups of texts that are edits of one another.

Texts are sets of shingles (hashes of consecutive words). Each set has a parity sketch: bit i is the parity of the number of
shingles hashed to i, so the exclusive-or of two sketches is the sketch of the sets' symmetric difference, and its number of
bits is never more than the size of that difference. Sets of sizes a and b with similarity s differ in at most
``(1 - s) / (1 + s) * (a + b)`` shingles - the radius: a pair whose sketches differ in more bits can be ruled out without
loss. Blocks of texts that share a band of two min-hashes are compared so, tile against tile; what is left is compared by
the shingles themselves.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.sources.tables import cut, spread

#: Bands of two min-hashes: at similarity 0.6 a pair shares none with probability 0.64 ** 20 = 0.00013, at 0.7 with 0.0000014.
BANDS = 20
#: Further min-hashes by which a hot band is split: a pair at similarity 0.6 shares none of them with probability 0.4 ** 12 = 0.00002.
MORE = 12
#: Members of a block above which it is split by these, and what is still above it into parts compared pair by pair, members of a part, rows of a tile, ids or bands
#: up to which they are broadcast, and copies up to which a class of exact copies is given as all its pairs.
HOT, PART, TILE, BROADCAST, EXPAND = 4096, 2048, 512, 200_000, 64
#: Tolerance of comparisons with a bound that is a product of floating-point numbers; the compared numbers are whole.
SLACK = 1e-6

_WORDS = re.compile(r"[^\W_]+")


class _Hashes(dict):
    def __missing__(self, word: str) -> int:
        if len(self) > 300_000:
            self.clear()
        self[word] = made = xxhash.xxh64_intdigest(word)
        return made


_hashes = _Hashes()


def words_of(text: str | None) -> list[str]:
    """Maximal runs of letters and digits in lower case."""
    return _WORDS.findall(text.lower()) if text else []


def shingles(words: list[str], width: int) -> np.ndarray:
    """The distinct hashes of ``width`` consecutive words, sorted; empty if there are fewer words."""
    n = len(words) - width + 1
    if n < 1:
        return np.empty(0, np.uint64)
    own = np.fromiter(map(_hashes.__getitem__, words), np.uint64, len(words))
    made = np.zeros(n, np.uint64)
    for k in range(width):
        made = (made ^ own[k : k + n]) * np.uint64(0x9E3779B97F4A7C15)
        made ^= made >> np.uint64(29)
    made *= np.uint64(0xBF58476D1CE4E5B9)
    return np.unique(made ^ (made >> np.uint64(32)))


#: Shingles above which a sketch has twice as many bits: sketches have 256 << level bits, a third more than shingles at least.
_LEVELS = np.array([192 << i for i in range(24)])


def _level(size):
    return np.searchsorted(_LEVELS, size)


def sketch(own: np.ndarray, finer: int = 0) -> bytes:
    """The parity sketch of a set; ``finer``: with 2 ** finer times as many bits."""
    bits = 256 << (int(_level(len(own))) + finer)
    return np.packbits((np.bincount((own & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1).astype(np.uint8), bitorder="little").tobytes()


def fold(made: np.ndarray) -> np.ndarray:
    """Sketches (row, word) with half as many bits."""
    half = made.shape[1] // 2
    return made[:, :half] ^ made[:, half:]


_FACTORS = np.random.default_rng(7).integers(1, 1 << 63, 2 * BANDS + MORE, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_STEPS = np.arange(BANDS, dtype=np.uint64)


def _bands(own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys of the bands, and the further min-hashes."""
    least = (own[None, :] * _FACTORS[:, None]).min(axis=1)
    keys = (least[: 2 * BANDS : 2] * np.uint64(0x9E3779B97F4A7C15)) ^ least[1 : 2 * BANDS : 2]
    return (keys * np.uint64(0xBF58476D1CE4E5B9) + _STEPS).view(np.int64), least[2 * BANDS :].view(np.int64)


def signatures(chunks: DataFrame, key: str, width: int, least_words: int) -> DataFrame:
    """``id, class`` (hash of the words), ``size`` (shingles), ``sketch``, ``fine`` (one with four times as
    many bits), ``bands`` and ``more`` (further min-hashes) of texts with enough words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words = words_of(text)
                if i is not None and len(words) >= max(least_words, width):
                    own = shingles(words, width)
                    rows.append((i, xxhash.xxh3_128_digest(" ".join(words)), len(own), sketch(own), sketch(own, 2), *_bands(own)))
            names = [("id", pa.int64()), ("class", pa.binary()), ("size", pa.int32()), ("sketch", pa.binary()), ("fine", pa.binary()), ("bands", pa.list_(pa.int64())), ("more", pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], kind) for n, (_, kind) in enumerate(names)], [name for name, _ in names])

    return spread(chunks.select(F.col(key).cast("long"), "text")).mapInArrow(run, "id long, class binary, size int, sketch binary, fine binary, bands array<long>, more array<long>")


class _Block:
    """Rows of whole bands, sorted by band and size, that are compared with one another."""

    def __init__(self, rows: dict[str, np.ndarray], similarity: float):
        self.rows, self.similarity = rows, similarity
        self.radius = (1 - similarity) / (1 + similarity)
        self.level = _level(rows["size"])
        self.at = np.zeros(len(self.level), np.int64)  # where a row's sketch stands among those of its level
        self.own: dict[int, np.ndarray] = {}
        self.folded: dict[int, np.ndarray] = {}
        self.bits = np.zeros(len(self.level), np.int64)
        for level in np.unique(self.level):
            mine = np.flatnonzero(self.level == level)
            self.at[mine] = np.arange(len(mine))
            width = 32 << int(level)
            self.own[level] = rows["raw"][rows["from"][mine][:, None] + np.arange(width)].view(np.uint64)
            self.folded[level] = fold(self.own[level]) if level else self.own[level]
            self.bits[mine] = np.bitwise_count(self.own[level]).sum(axis=1)

    def sketches(self, rows: np.ndarray, level: int) -> np.ndarray:
        """At ``level``, of rows of that level or the next."""
        out = np.empty((len(rows), self.own[level].shape[1]), np.uint64)
        same = self.level[rows] == level
        out[same] = self.own[level][self.at[rows[same]]]
        if not same.all():
            out[~same] = self.folded[level + 1][self.at[rows[~same]]]
        return out

    def _fine(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rows that may be a pair by their sizes and, if the block is one of two parts, are of different parts; a's size is
        the smaller. Levels then differ by one at most, as long as the similarity is above a half."""
        size, part, split = self.rows["size"], self.rows["part"], self.rows["split"]
        return (size[a] >= self.similarity * size[b] - SLACK) & (~split[a] | (part[a] != part[b])) & (self.level[b] - self.level[a] <= 1)

    def near(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        band, size = self.rows["band"], self.rows["size"]
        starts = np.flatnonzero(np.r_[True, band[1:] != band[:-1]]) if len(band) else np.empty(0, int)
        lengths = np.diff(np.r_[starts, len(band)])
        small = np.repeat(lengths <= 64, lengths)
        for step in range(1, int(lengths[lengths <= 64].max(initial=1))):
            a = np.flatnonzero((band[step:] == band[:-step]) & small[:-step])
            if not len(a):
                break
            yield from self._compare(a, a + step)
        for start, length in zip(starts[lengths > 64], lengths[lengths > 64], strict=True):
            end = start + length
            for at in range(start, end, TILE):
                rows = np.arange(at, min(at + TILE, end))
                last = start + int(np.searchsorted(size[start:end], size[rows[-1]] / self.similarity + SLACK, "right"))
                for to in range(at, last, TILE):
                    yield from self._tile(rows, np.arange(to, min(to + TILE, last)))

    def _compare(self, a: np.ndarray, b: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        fine = self._fine(a, b)
        a, b = a[fine], b[fine]
        for level in np.unique(self.level[a]):
            x, y = a[self.level[a] == level], b[self.level[a] == level]
            away = np.bitwise_count(self.sketches(x, level) ^ self.sketches(y, level)).sum(axis=1, dtype=np.int64)
            near = away <= SLACK + self.radius * (self.rows["size"][x] + self.rows["size"][y])
            if near.any():
                yield x[near], y[near]

    def _tile(self, a: np.ndarray, b: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        size = self.rows["size"]
        for level in np.unique(self.level[a]):
            x = a[self.level[a] == level]
            y = b[(self.level[b] == level) | (self.level[b] == level + 1)]
            if not len(y):
                continue
            # a sketch of the next level folds to at most as many bits, so counts bound the distance only within a level
            if (self.level[y] == level).all():
                gap = max(self.bits[x].min() - self.bits[y].max(), self.bits[y].min() - self.bits[x].max())
                if gap > SLACK + self.radius * (size[x].max() + size[y].max()):
                    continue
            p, q = self.sketches(x, level), self.sketches(y, level)
            away = np.zeros((len(x), len(y)), np.int32)
            for word in range(p.shape[1]):
                away += np.bitwise_count(p[:, word, None] ^ q[None, :, word])
            i, j = np.nonzero(away <= SLACK + self.radius * (size[x][:, None] + size[y][None, :]))
            i, j = x[i], y[j]
            keep = i < j
            keep[keep] = self._fine(i[keep], j[keep])
            if keep.any():
                yield i[keep], j[keep]


def _hot(rows: DataFrame) -> tuple[DataFrame, int]:
    """Bands with more than ``HOT`` rows, with ``n``, and how many they are."""
    found = cut(rows.groupBy("band").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > HOT))
    return found, found.count()


def _candidates(reps: DataFrame, similarity: float) -> DataFrame:
    """Distinct pairs ``a, b`` of representatives that share a band and whose sketches are within the radius.

    A hot band, of more than ``HOT`` rows, is split by ``MORE`` further min-hashes: each row goes to as many smaller bands. Only
    what is hot even then - texts that are nearly all alike - is split into parts that are compared pair by pair."""
    rows = reps.select("id", "size", "sketch", F.explode("bands").alias("band"))  # a repeated row meets itself only
    hot, n_hot = _hot(rows)
    whole = [F.lit(0).alias(c) for c in ("part", "one", "two")]
    if n_hot:
        sent = lambda df, n: F.broadcast(df) if n <= BROADCAST else df
        cold = rows.join(sent(hot, n_hot), "band", "left_anti").select("id", "size", "sketch", "band", *whole)
        members = reps.select("id", "size", "sketch", "more", F.explode("bands").alias("band")).join(sent(hot, n_hot).drop("n"), "band")
        split = members.select("id", "size", "sketch", "band", F.posexplode("more").alias("at", "least")).withColumn("band", F.xxhash64("band", "at", "least"))
        split = cut(split.select("id", "size", "sketch", "band"))
        still, n_still = _hot(split)
        split = split.join(sent(still.select("band", F.ceil(F.col("n") / PART).cast("int").alias("parts")), n_still), "band", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
        split = split.withColumn("part", F.pmod(F.xxhash64("id"), "parts").cast("int")).select("*", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other"))
        rows = cold.unionByName(split.select("id", "size", "sketch", "band", "part", F.least("part", "other").alias("one"), F.greatest("part", "other").alias("two")))
    else:
        rows = rows.select("id", "size", "sketch", "band", *whole)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def pairs(table: pa.Table) -> pa.RecordBatch:
            got = {c: table.column(c).to_numpy() for c in ("id", "size", "part", "one", "two")}
            got["split"] = got["one"] != got["two"]
            new = np.ones(len(table), bool)
            for c in ("band", "one", "two"):
                got[c] = table.column(c).to_numpy()
            new[1:] = (got["band"][1:] != got["band"][:-1]) | (got["one"][1:] != got["one"][:-1]) | (got["two"][1:] != got["two"][:-1])
            got["band"] = np.cumsum(new)
            sketches = table.column("sketch").combine_chunks()
            sketches = sketches.chunk(0) if isinstance(sketches, pa.ChunkedArray) else sketches
            got["from"] = np.frombuffer(sketches.buffers()[1], np.int32, len(sketches) + 1, 4 * sketches.offset)[:-1].astype(np.int64)
            together = np.flatnonzero(np.bincount(got["band"])[got["band"]] > 1)  # most blocks are of one row
            got = {c: x[together] for c, x in got.items()} | {"raw": np.frombuffer(sketches.buffers()[2], np.uint8)}
            made = [np.stack([got["id"][a], got["id"][b]], axis=1) for a, b in _Block(got, similarity).near()]
            found = np.unique(np.sort(np.concatenate(made), axis=1), axis=0) if made else np.empty((0, 2), np.int64)
            found = found[found[:, 0] < found[:, 1]]
            return pa.RecordBatch.from_arrays([pa.array(found[:, 0]), pa.array(found[:, 1])], ["a", "b"])

        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not len(batch):
                continue
            held.append(batch)
            if sum(map(len, held)) < 50_000:
                continue
            table = pa.Table.from_batches(held).combine_chunks()
            band, one, two = (table.column(c).to_numpy() for c in ("band", "one", "two"))
            whole = np.flatnonzero((band != band[-1]) | (one != one[-1]) | (two != two[-1]))  # the last block may go on
            stop = int(whole[-1]) + 1 if len(whole) else 0
            if stop:
                yield pairs(table.slice(0, stop).combine_chunks())
            held = table.slice(stop).combine_chunks().to_batches()
        if held:
            yield pairs(pa.Table.from_batches(held).combine_chunks())

    own = ("band", "one", "two")
    return rows.repartition(*own).sortWithinPartitions(*own, "size").mapInArrow(run, "a long, b long").distinct()


def _small(ids: DataFrame) -> DataFrame:
    """``ids`` to be broadcast if they are at most ``BROADCAST``."""
    return F.broadcast(ids) if ids.limit(BROADCAST + 1).count() <= BROADCAST else ids


def _finer(reps: DataFrame, pairs: DataFrame, similarity: float) -> DataFrame:
    """The pairs whose finer sketches are within the radius as well; nothing that is similar is lost here either."""
    radius = (1 - similarity) / (1 + similarity)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y, n in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), batch.column(4).to_pylist(), strict=True):
                p, q = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                while len(p) != len(q):
                    p, q = (fold(p[None])[0], q) if len(p) > len(q) else (p, fold(q[None])[0])
                keep.append(int(np.bitwise_count(p ^ q).sum()) <= SLACK + radius * n)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    pairs = cut(pairs)
    ids = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    own = reps.select("id", "size", "fine").join(_small(cut(ids)), "id", "left_semi").dropDuplicates(["id"])
    joined = pairs.join(own.toDF("a", "size_a", "fine_a"), "a").join(own.toDF("b", "size_b", "fine_b"), "b")
    return joined.select("a", "b", "fine_a", "fine_b", (F.col("size_a") + F.col("size_b")).alias("n")).mapInArrow(run, "a long, b long")


def _verified(chunks: DataFrame, key: str, pairs: DataFrame, width: int, similarity: float) -> DataFrame:
    """``a, b, similarity`` of the pairs that are similar by their shingles."""

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([shingles(words_of(t), width).tobytes() for t in batch.column(1).to_pylist()], pa.binary())], ["id", "own"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            shared = []
            for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                p, q = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = np.sort(np.concatenate([p, q]))
                same = int((both[1:] == both[:-1]).sum())
                shared.append(same / max(1, len(both) - same))
            made = pa.array(shared, pa.float64())
            keep = pa.array([s >= similarity for s in shared], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), made], ["a", "b", "similarity"]).filter(keep)

    needed = cut(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct())
    texts = chunks.select(F.col(key).cast("long").alias("id"), "text").join(_small(needed), "id", "left_semi").dropDuplicates(["id"])
    own = cut(texts.mapInArrow(sets, "id long, own binary"))
    joined = pairs.join(own.withColumnsRenamed({"id": "a", "own": "own_a"}), "a").join(own.withColumnsRenamed({"id": "b", "own": "own_b"}), "b")
    return joined.select("a", "b", "own_a", "own_b").mapInArrow(compare, "a long, b long, similarity double")


def similar(chunks: DataFrame, key: str = "chunk_id", width: int = 5, similarity: float = 0.8, least_words: int = 0) -> tuple[DataFrame, DataFrame]:
    """Pairs ``a, b, similarity`` of class representatives, and the membership ``id, representative, copies``.

    A class holds the texts with the same words, its representative is the lowest id. Two representatives are a pair if the
    share of distinct runs of ``width`` words that both have among those that one has is at least ``similarity`` (which must
    be above 0.5). Rows with null ids or texts, or with fewer than ``least_words`` or ``width`` words, are in neither result;
    rows repeated under one id count once; no number of partners is capped.
    """
    if not 0.5 < similarity <= 1:
        raise ValueError("similarity must be above 0.5")
    made = cut(signatures(chunks, key, width, least_words))
    known = made.select("class", "id").distinct()
    classes = known.groupBy("class").agg(F.min("id").alias("representative"), F.count(F.lit(1)).alias("copies"))
    members = cut(known.join(classes, "class").select("id", "representative", "copies"))
    copies = members.where("id <> representative").select("id")
    reps = made.join(_small(copies), "id", "left_anti").select("id", "size", "sketch", "fine", "bands", "more")
    near = _finer(reps, _candidates(reps, similarity), similarity)
    return _verified(chunks, key, cut(near), width, similarity), members


def pairs_of_rows(pairs: DataFrame, members: DataFrame, expand: int = EXPAND) -> DataFrame:
    """Pairs ``a < b`` of ids: those of representatives carried over to their copies, and those among copies.

    A class of more than ``expand`` exact copies stands for itself: its copies are paired with its representative only, and
    only the representative with other texts. So the result grows with the input, and no link between texts is lost.
    """
    several = cut(members.where(F.col("copies") > 1))
    few = several.where(F.col("copies") <= expand).select("id", "representative")
    for end in ("a", "b"):
        pairs = pairs.join(few.withColumnsRenamed({"id": f"_{end}", "representative": end}), end, "left").withColumn(end, F.coalesce(f"_{end}", end)).drop(f"_{end}")
    among = few.select(F.col("id").alias("a"), "representative").join(few.select(F.col("id").alias("b"), "representative"), "representative").where("a < b").select("a", "b")
    star = several.where((F.col("copies") > expand) & (F.col("id") != F.col("representative"))).select(F.col("representative").alias("a"), F.col("id").alias("b"))
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).unionByName(among).unionByName(star)


def grouped(pairs: DataFrame, members: DataFrame) -> DataFrame:
    """One row an id: ``id, group`` (the lowest id that it is linked with over any number of pairs) and ``links`` (pairs of
    its class). Connected components by joining each node to the lowest it knows, halving paths, until nothing changes."""
    edges = cut(pairs.select(F.explode(F.array(F.struct(F.col("a").alias("u"), F.col("b").alias("v")), F.struct(F.col("b").alias("u"), F.col("a").alias("v")))).alias("e")).select("e.u", "e.v"))
    label = cut(edges.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("label")))
    while True:
        reached = edges.join(label.withColumnsRenamed({"u": "v"}), "v").groupBy("u").agg(F.min("label").alias("seen"))
        moved = label.join(reached, "u").select("u", F.col("label").alias("old"), F.least("label", "seen").alias("mid"))
        up = label.select(F.col("u").alias("mid"), F.col("label").alias("top"))
        after = cut(moved.join(up, "mid", "left").select("u", "old", F.coalesce("top", "mid").alias("label")))
        label = after.select("u", "label")
        if not after.where("label <> old").limit(1).count():
            break
    links = edges.groupBy("u").agg(F.count(F.lit(1)).alias("links"))
    known = members.join(label.withColumnsRenamed({"u": "representative"}), "representative", "left").join(links.withColumnsRenamed({"u": "representative"}), "representative", "left")
    return known.select("id", F.coalesce("label", "representative").alias("group"), "representative", F.coalesce("links", F.lit(0)).alias("links"))
