"""Evaluation items leaking into documents: shared runs of consecutive words, by a prefix-filtered set join.

A document and an item that share ``run`` consecutive words share all ``run - size + 1`` word shingles of that run: the
overlap asked for is the whole window, so the necessary prefix of a window, its shingles in order of rarity, has length
one. So:

1. the shingles that items and corpus share are counted over the corpus, in documents; nothing else of it is kept;
2. every item window names its rarest shingle as its probe; a window with a shingle the corpus lacks has none;
3. the corpus is joined with the probes only. Length and position bound the hits: the window a hit implies must lie inside
   both texts. What is left are diagonals (word offset of the document minus that of the item);
4. the words along a diagonal are compared one by one over the item-sized window around it.

Words are maximal runs of letters and digits of the lower-cased text; tags and character references between words are
markup and count as spaces. Texts are read once, into word codes of 64 bits, which all steps work on. The item shingles go
to the workers if a count proves them few (SEND) and are joined otherwise; both ways give the same rows.

Defined results: null and empty texts, texts shorter than ``run`` words and empty tables give no rows; repeated documents
are each reported; ties in rarity are broken by the shingle's hash; ids may be of any type. Other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from feedloom.runtime import maybe_broadcast, written

RUN = 13
SIZE = 5
#: Shingles of items are sent to the workers if a count proves them this few; beyond it they are joined.
SEND = 2_000_000
ROWS = 1_000

_MARKUP = re.compile(r"</?[A-Za-z][^<>]*>|&(?:[A-Za-z]{2,8}|#x?[0-9A-Fa-f]{1,6});")
_WORD = re.compile(r"[^\W_]+")


def words_of(text: str) -> list[str]:
    """Lower-cased words without the markup between them."""
    if "<" in text or "&" in text:
        text = _MARKUP.sub(" ", text)
    return _WORD.findall(text.lower())


def _streams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import xxhash

    known: dict[str, int] = {}
    for batch in batches:
        for lo in range(0, batch.num_rows, ROWS):
            part = batch.slice(lo, ROWS)
            flat: list[int] = []
            ends = [0]
            for t in part.column("t"):
                for w in words_of(t.as_py()) if t.is_valid else ():
                    h = known.get(w)
                    if h is None:
                        if len(known) > 500_000:
                            known.clear()
                        h = known[w] = xxhash.xxh64_intdigest(w)
                    flat.append(h)
                ends.append(len(flat))
            ws = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.array(flat, np.uint64).view(np.int64)))
            yield pa.RecordBatch.from_arrays([part.column("id"), ws], names=["id", "ws"])


def _read(df: DataFrame, key: str, text: str, run: int, label: str) -> DataFrame:
    """(id, ws) of texts of run words or more."""
    slim = df.select(F.col(key).alias("id"), F.col(text).cast("string").alias("t"))
    kind = slim.schema["id"].dataType.simpleString()
    return written(slim.mapInArrow(_streams, f"id {kind}, ws array<bigint>").filter(F.size("ws") >= run), label)


def _rolled(batch: pa.RecordBatch, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, position and hash of every shingle of a slice."""
    lists = batch.column(batch.schema.get_field_index("ws"))
    words = lists.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
    lengths = np.diff(lists.offsets.to_numpy())
    n = len(words) - size + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    row = np.repeat(np.arange(len(lengths)), lengths)
    at = np.arange(len(words)) - np.repeat(np.concatenate([[0], np.cumsum(lengths)[:-1]]), lengths)
    h = np.zeros(n, np.uint64)
    for k in range(size):
        h = (h ^ words[k:k + n]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(31)
    keep = row[:n] == row[size - 1:]
    return row[:n][keep], at[:n][keep], h.view(np.int64)[keep]


def _shingles(size: int, wanted=None):
    """(id, pos, h) of all shingles, or of those in a broadcast sorted array."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, ROWS):
                part = batch.slice(lo, ROWS)
                row, at, h = _rolled(part, size)
                if wanted is not None:
                    known = wanted.value
                    hit = known[np.minimum(np.searchsorted(known, h), len(known) - 1)] == h if len(known) else np.zeros(len(h), bool)
                    row, at, h = row[hit], at[hit], h[hit]
                yield pa.RecordBatch.from_arrays([part.column("id").take(pa.array(row)), pa.array(at.astype(np.int32)), pa.array(h)], names=["id", "pos", "h"])

    return run


def _hits(docs: DataFrame, wanted: DataFrame, size: int, send: int) -> DataFrame:
    """(id, pos, h): where the corpus holds one of the wanted shingles (distinct h)."""
    schema = f"id {docs.schema['id'].dataType.simpleString()}, pos int, h bigint"
    if wanted.count() <= send:
        known = docs.sparkSession.sparkContext.broadcast(np.sort(wanted.toPandas()["h"].to_numpy(np.int64)))
        return docs.mapInArrow(_shingles(size, known), schema)
    return docs.mapInArrow(_shingles(size), schema).join(wanted, "h")


def leaks(docs: DataFrame, items: DataFrame, *, doc: str = "doc_id", item: str = "item_id", text: str = "text", run: int = RUN, size: int = SIZE, send: int = SEND) -> DataFrame:
    """Distinct (doc, item) that share at least run consecutive words, with the longest shared run."""
    corpus, tests = _read(docs, doc, text, run, "leak-docs"), _read(items, item, text, run, "leak-items")
    item_sh = written(tests.mapInArrow(_shingles(size), f"id {tests.schema['id'].dataType.simpleString()}, pos int, h bigint"), "leak-shingles")
    shared = _hits(corpus, written(item_sh.select("h").distinct(), "leak-wanted"), size, send)
    rarity = written(shared.select("id", "h").distinct().groupBy("h").agg(F.count("*").alias("df")), "leak-rarity")

    span = run - size + 1
    ahead = W.partitionBy("id").orderBy("pos").rowsBetween(0, span - 1)
    windows = (
        item_sh.join(maybe_broadcast(rarity), "h", "left")
        .withColumn("probe", F.min(F.struct("df", "h", F.col("pos").alias("at"))).over(ahead))
        .withColumn("n", F.count("df").over(ahead))
        .filter(F.col("n") == span)
    )
    probes = written(windows.select(F.col("id").alias("item"), F.col("probe.h").alias("h"), F.col("probe.at").alias("ipos"), (F.col("probe.at") - F.col("pos")).alias("back")).distinct(), "leak-probes")
    hits = _hits(corpus, written(probes.select("h").distinct(), "leak-prefix"), size, send).withColumnRenamed("id", "doc")
    first = F.col("pos") - F.col("back")
    found = written(hits.join(maybe_broadcast(probes), "h").filter(first >= 0).select("doc", "item", (F.col("pos") - F.col("ipos")).alias("diagonal"), (first + run).alias("end")).groupBy("doc", "item", "diagonal").agg(F.min("end").alias("end")), "leak-diagonals")

    d, i = corpus.select(F.col("id").alias("doc"), F.col("ws").alias("dw")), tests.select(F.col("id").alias("item"), F.col("ws").alias("iw"))
    both = d.join(maybe_broadcast(found), "doc").filter(F.size("dw") >= F.col("end")).join(maybe_broadcast(i), "item")
    start_d, start_i = F.greatest(F.col("diagonal"), F.lit(0)), F.greatest(-F.col("diagonal"), F.lit(0))
    n = F.least(F.size("dw") - start_d, F.size("iw") - start_i)
    same = F.zip_with(F.slice("dw", start_d + 1, n), F.slice("iw", start_i + 1, n), lambda a, b: F.when(a == b, "1").otherwise("0"))
    runs = F.regexp_extract_all(F.array_join(same, ""), F.lit(f"(1{{{run},}})"), F.lit(1))
    longest = F.array_max(F.transform(runs, lambda r: F.length(r)))
    return both.withColumn("longest", longest).filter(F.col("longest") >= run).groupBy(F.col("doc").alias(doc), F.col("item").alias(item)).agg(F.max("longest").alias("longest_run"))
