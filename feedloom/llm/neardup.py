"""Near-duplicate texts: all pairs of word sets with a Jaccard similarity of at least 0.8, found exactly.

Sets that share at least a share t of their union differ in at most d = (1-t)/(1+t) * (|A|+|B|) words. Every word is
hashed to a segment, and a text is embedded as its count of words per segment (segment popcounts of its word bitmap).
The Manhattan distance of two embeddings never exceeds the number of differing words, so pairs farther apart than d are
no near-duplicates: a bound that loses nothing. Counts are written in unary, so that the distance of 32 segments is one
popcount of an exclusive or of two words of 64 bits; the parities of 64 finer segments, 64 bits more, bound it from
below at a third of the cost and are tried first.

A plain grid over these few dense counts prunes next to nothing at 0.8 (d is four to five standard deviations of a
segment's count wide, in every axis), so the grid is laid over the sparse ends of the same embedding: with words as the
finest segments, ordered from rare to common, two sets within d share one of the first few occupied cells of each. A
cell's texts are joined over the range of sizes and positions that d allows (shorter texts only with their first ninth).
Surviving pairs are verified on the whole word sets.

Copies are collapsed first: texts with the same word set form a class with one representative. Cells with more than
BLOCK texts are split into blocks that run on different tasks, so a cell that holds a third of all rows is never one
task's work, and no row, cell or partner is capped. Rarity is read from a table of SLOTS counters, of fixed
size at any scale; any order gives the same result.

Defined results: null texts and texts of fewer than min_words distinct words have no partners; repeated deliveries of
one id count once (smallest text first); an empty table gives no pairs; ids are strings, other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedloom.operators.components import components
from feedloom.runtime import maybe_broadcast, written

SLOTS = 1 << 18
BLOCK = 8192
LONGER, SHORTER, BOTH = 0, 1, 2
#: Up to this many byte-identical texts are expanded into all pairs; of more, one record represents the text.
EXPAND = 64
#: Classes of more records than this are expanded in blocks that run on different tasks.
SPREAD = 1000
NUM, DEN = 4, 5  # the threshold 4/5 as whole numbers: no rounding at the border


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(r"([\p{L}\p{N}]+)"), F.lit(1))


def word_sets(records: DataFrame, min_words: int) -> DataFrame:
    """(rec, key, same, n, hs): hashes of the distinct words, sorted; key identifies the set, same the text. Written once."""
    hs = F.array_sort(F.array_distinct(F.transform(words_of(F.col("text")), lambda w: F.xxhash64(w))))
    sets = records.select("rec", F.xxhash64("text").alias("same"), hs.alias("hs")).filter(F.size("hs") >= min_words)
    return written(sets.select("rec", F.xxhash64("hs").alias("key"), "same", F.size("hs").alias("n"), "hs"), "nd-sets")


def _prefix(batch: pa.RecordBatch, rarity: np.ndarray):
    """Flat arrays over the batch's prefix words: row, word hash, position."""
    lists = batch.column(batch.schema.get_field_index("hs"))
    flat = lists.flatten().to_numpy(zero_copy_only=False)
    lengths = np.diff(lists.offsets.to_numpy())
    row = np.repeat(np.arange(len(lengths)), lengths)
    order = np.lexsort((flat, rarity[flat & (SLOTS - 1)], row))
    starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    position = np.arange(len(flat)) - np.repeat(starts, lengths)
    keep = position <= np.repeat(lengths - -(-NUM * lengths // DEN), lengths)
    return flat, row, lengths, row[order][keep], flat[order][keep], position[keep]


def embed(flat: np.ndarray, row: np.ndarray, n_rows: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Parities of 64 segments, and counts of 32 segments in unary (up to four a segment) as two words."""
    seg64 = ((flat >> 20) & 63).astype(np.int64)
    odd = (np.bincount(row * 64 + seg64, minlength=n_rows * 64).reshape(n_rows, 64) & 1).astype(np.uint64)
    parity = (odd << np.arange(64, dtype=np.uint64)).sum(axis=1, dtype=np.uint64)
    count = np.minimum(np.bincount(row * 32 + (((flat >> 32) & 31).astype(np.int64)), minlength=n_rows * 32).reshape(n_rows, 32), 4)
    unary = ((np.uint64(1) << count.astype(np.uint64)) - np.uint64(1)).reshape(n_rows, 2, 16)
    words = (unary << (np.arange(16, dtype=np.uint64) * np.uint64(4))).sum(axis=2, dtype=np.uint64)
    return parity, words[:, 0], words[:, 1]


def _cell_counter(rarity):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(SLOTS, np.int64)
        for batch in batches:
            if batch.num_rows:
                word = _prefix(batch, rarity.value)[4]
                total += np.bincount(word & (SLOTS - 1), minlength=SLOTS)
        slot = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(slot), pa.array(total[slot])], names=["slot", "n"])

    return run


def _cells(rarity, blocks):
    """Rows of the grid: a text in each of its cells. In a cell of several blocks it is the longer text of its pairs in one
    block only; texts that may be the shorter one, which a frequent word's cell has few of, stand in all blocks."""
    names = ["cell", "block", "side", "key", "n", "pos", "parity", "u0", "u1"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            flat, row, lengths, r, word, pos = _prefix(batch, rarity.value)
            parity, u0, u1 = embed(flat, row, len(lengths))
            key = batch.column(batch.schema.get_field_index("key")).to_numpy(zero_copy_only=False)
            nb = blocks.value[word & (SLOTS - 1)].astype(np.int64)
            own = ((key[r] >> 7) & 0x7FFFFFFF) % nb
            front = 9 * pos <= lengths[r]
            times = np.where(front, nb, 1)
            reps = np.repeat(np.arange(len(r)), times)
            first = np.concatenate([[0], np.cumsum(times)[:-1]])
            block = np.where(front[reps], np.arange(len(reps)) - np.repeat(first, times), own[reps])
            side = np.where(block == own[reps], np.where(front[reps], BOTH, LONGER), SHORTER).astype(np.int8)
            r2 = r[reps]
            cols = [word[reps], block, side, key[r2], lengths[r2].astype(np.int32), pos[reps].astype(np.int32), parity[r2].view(np.int64), u0[r2].view(np.int64), u1[r2].view(np.int64)]
            for k in range(0, len(reps), 50_000):
                yield pa.RecordBatch.from_arrays([pa.array(c[k:k + 50_000]) for c in cols], names=names)

    return run


CELL = "cell long, block long, side byte, key long, n int, pos int, parity long, u0 long, u1 long"


def compare(c: dict[str, np.ndarray], rows: int = 512) -> tuple[np.ndarray, np.ndarray]:
    """Keys of the pairs in one cell (or block of it) that the bounds allow. c is sorted by n."""
    n, pos, key, parity = c["n"].astype(np.int64), c["pos"].astype(np.int64), c["key"], c["parity"].view(np.uint64)
    front = np.flatnonzero((9 * pos <= n) & (c["side"] != LONGER))  # only these may be the shorter text of a pair
    longer = c["side"] != SHORTER
    fn, fp = n[front], parity[front]
    reach = (5 * n - 9 * pos) // 4  # the largest partner that still shares enough words after this position
    out_a, out_b = [], []
    for some in (np.flatnonzero(longer & (reach >= n)), np.flatnonzero(longer & (reach < n))):
        some = some[np.argsort(np.minimum(reach[some], n[some]), kind="stable")]
        for k in range(0, len(some), rows):
            x = some[k:k + rows]
            lo = np.searchsorted(fn, -(-NUM * n[x].min() // DEN))
            up = np.searchsorted(fn, np.minimum(reach[x], n[x]).max(), side="right")
            for j in range(lo, up, 8192):
                y = slice(j, min(up, j + 8192))
                near = np.bitwise_count(parity[x][:, None] ^ fp[y][None, :]) <= np.minimum(2 * n[x] // 9, 64).astype(np.uint8)[:, None]  # 64 parities differ at most
                a, b = np.nonzero(near)
                if not len(a):
                    continue
                a, b = x[a], front[y][b]
                d = (n[a] + n[b]) // 9
                ok = (key[a] != key[b]) & ((n[b] < n[a]) | ((n[b] == n[a]) & (key[b] < key[a]))) & (NUM * n[a] <= DEN * n[b]) & (n[b] <= reach[a]) & (n[a] <= reach[b])
                ok &= np.bitwise_count(parity[a] ^ parity[b]) <= d
                a, b, d = a[ok], b[ok], d[ok]
                u = sum(np.bitwise_count(c[w].view(np.uint64)[a] ^ c[w].view(np.uint64)[b]).astype(np.int64) for w in ("u0", "u1"))
                a, b = a[u <= d], b[u <= d]
                out_a.append(np.minimum(key[a], key[b]))
                out_b.append(np.maximum(key[a], key[b]))
    if not out_a:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(out_a), np.concatenate(out_b)


def _join_cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches arrive sorted by cell, block and n; only one block is held at a time."""
    open_parts: list[dict[str, np.ndarray]] = []

    def close() -> pa.RecordBatch | None:
        if not open_parts:
            return None
        c = {k: np.concatenate([p[k] for p in open_parts]) for k in open_parts[0]}
        open_parts.clear()
        if len(c["n"]) < 2:
            return None
        a, b = compare(c)
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["ka", "kb"]) if len(a) else None

    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        c = {f: batch.column(i).to_numpy(zero_copy_only=False) for i, f in enumerate(batch.schema.names)}
        change = np.flatnonzero((np.diff(c["cell"]) != 0) | (np.diff(c["block"]) != 0)) + 1
        bounds = [0, *change.tolist(), batch.num_rows]
        for s, e in zip(bounds, bounds[1:]):
            ident = (c["cell"][s], c["block"][s])
            if ident != last:
                done = close()
                if done is not None:
                    yield done
                last = ident
            open_parts.append({k: v[s:e] for k, v in c.items()})
    done = close()
    if done is not None:
        yield done


def _bounded_table(counts: DataFrame) -> np.ndarray:
    """A table of SLOTS counters on the driver: its size is fixed."""
    out = np.zeros(SLOTS, np.int64)
    got = counts.toPandas()
    out[got["slot"].to_numpy(np.int64)] = got["n"].to_numpy(np.int64)
    return out


def similar_classes(records: DataFrame, min_words: int = 20) -> tuple[DataFrame, DataFrame]:
    """(ka, kb): classes of records with at least four fifths of their words in common, and (rec, key, same): membership.

    records: (rec STRING, text STRING), one row per record.
    """
    spark = records.sparkSession
    sc = spark.sparkContext
    sets = word_sets(records, min_words)
    members = sets.select("rec", "key", "same")
    many = written(members.groupBy("key").agg(F.min("rec").alias("rep"), F.count("*").alias("copies")).filter("copies > 1"), "nd-copies")
    extra = members.join(maybe_broadcast(many), "key").filter("rec <> rep").select("rec")
    classes = sets.join(maybe_broadcast(extra), "rec", "left_anti")

    slot = F.col("h").bitwiseAND(F.lit(SLOTS - 1)).alias("slot")
    rarity = sc.broadcast(_bounded_table(classes.select(F.explode("hs").alias("h")).groupBy(slot).agg(F.count("*").alias("n"))))
    slim = classes.select("key", "hs")
    full = _bounded_table(slim.mapInArrow(_cell_counter(rarity), "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n")))
    blocks = sc.broadcast(np.maximum(-(-full // BLOCK), 1).astype(np.int32))
    cells = slim.mapInArrow(_cells(rarity, blocks), CELL)
    cells = cells.repartition("cell", "block").sortWithinPartitions("cell", "block", "n")
    maybe = written(cells.mapInArrow(_join_cells, "ka long, kb long").distinct(), "nd-maybe")

    needed = maybe.select(F.col("ka").alias("key")).unionByName(maybe.select(F.col("kb").alias("key"))).distinct()
    known = slim.join(maybe_broadcast(needed), "key", "left_semi")
    a, b = known.select(F.col("key").alias("ka"), F.col("hs").alias("ha")), known.select(F.col("key").alias("kb"), F.col("hs").alias("hb"))
    common = F.size(F.array_intersect("ha", "hb"))
    verified = maybe.join(a, "ka").join(b, "kb").filter(DEN * common >= NUM * (F.size("ha") + F.size("hb") - common))
    return written(verified.select("ka", "kb"), "nd-pairs"), members


def similar_pairs(records: DataFrame, min_words: int = 20) -> DataFrame:
    """(rec_a, rec_b), rec_a < rec_b: all pairs; of more than EXPAND byte-identical texts, pairs with their representative."""
    pairs, members = similar_classes(records, min_words)
    sizes = members.groupBy("key").agg(F.count("*").alias("copies"))
    large = members.groupBy("key", "same").agg(F.count("*").alias("copies"), F.min("rec").alias("rep")).filter(F.col("copies") > EXPAND).drop("copies")
    # rows that stand for their class in a product: all members but the copies of a represented text
    linked = pairs.select(F.col("ka").alias("key")).unionByName(pairs.select(F.col("kb").alias("key"))).distinct()
    used = members.join(maybe_broadcast(sizes.filter(F.col("copies") > 1).select("key").unionByName(linked).distinct()), "key", "left_semi")
    shown = written(used.join(maybe_broadcast(large), ["key", "same"], "left").filter("rep IS NULL OR rec = rep").select("key", "rec"), "nd-shown")
    wide = written(shown.groupBy("key").agg(F.count("*").alias("n")).filter(F.col("n") > SPREAD).select("key", F.ceil(F.col("n") / SPREAD).cast("int").alias("blocks")), "nd-wide")
    hint = maybe_broadcast(wide)
    blocks = F.coalesce("blocks", F.lit(1))
    b = shown.join(hint, "key", "left").select(F.col("key").alias("kb"), F.col("rec").alias("y"), F.explode(F.sequence(F.lit(0), blocks - 1)).alias("block"))
    # a class is a partner of itself; a record meets all of its partner class in one block of it
    x = shown.select(F.col("key").alias("ka"), F.col("rec").alias("x"))
    meets = pairs.join(x, "ka").select(F.col("kb").alias("key"), "x", F.lit(False).alias("own")).unionByName(x.select(F.col("ka").alias("key"), "x", F.lit(True).alias("own")))
    meets = meets.join(hint, "key", "left").select(F.col("key").alias("kb"), "x", "own", F.pmod(F.xxhash64("x"), blocks).cast("int").alias("block"))
    met = meets.join(b, ["kb", "block"]).filter("NOT own OR x < y").select("x", "y")
    star = members.join(maybe_broadcast(large), ["key", "same"]).filter("rec <> rep").select(F.col("rep").alias("x"), F.col("rec").alias("y"))
    return met.unionByName(star).select(F.least("x", "y").alias("rec_a"), F.greatest("x", "y").alias("rec_b")).distinct()


def groups(records: DataFrame, min_words: int = 20) -> DataFrame:
    """(rec, group_id, n_links): every record of at least min_words words, its group's smallest class key and its class's links."""
    pairs, members = similar_classes(records, min_words)
    both = pairs.unionByName(pairs.select(F.col("kb").alias("ka"), F.col("ka").alias("kb")))
    links = both.groupBy(F.col("ka").alias("key")).agg(F.count("*").alias("n_links"))
    label = components(pairs, "ka", "kb").select(F.col("id").alias("key"), "component")
    return (
        members.join(label, "key", "left").join(links, "key", "left")
        .select("rec", F.coalesce("component", "key").alias("group_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"))
    )
