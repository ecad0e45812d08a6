"""Keyword-stuffed and link-list pages, by the mean pointwise mutual information of neighbouring words.

Neighbouring words are counted over the whole corpus, all in one unit, documents: in how many a pair of words occurs (once
for each), and the sums of these counts by first and by second word. A pair's worth on a page is its normalised pointwise
mutual information from the other documents' counts, the page's own left out, so that a page cannot vouch for itself:
0 for a pair no other document has, up to 1 for words that always go together. Excessively repeated collocations (BURST
occurrences or more per document having it) are worth 0, and so are the words of links. Lines with a clock time are log
lines, which repeat by nature: their collocations may, up to REPEATS lines on a page that differ in their time stamp only, but their pairs need
other documents just the same. Pairs of numbers tell nothing and have no part in a mean.

The mean worth of the pairs around a word (REACH words to either side) tells running text from word salad, lists and
tags. Its level depends on the corpus, so the border is HALF of the corpus' own median: the words of a page whose mean
lies below stand in such passages, and a page of which more than SHARE do is flagged.

Copies (the same words in the same order, numbers aside) count as one document, so that a list crawled several times
cannot vouch for itself; each copy still gets its score. Words have codes of 64 bits; pairs are counted by both, with
sums on the map side, so that no frequent word is a hot key. Values of pairs go to the workers if a count proves them
few (SEND), and are joined otherwise; both ways score alike.

Defined results: null texts and texts of fewer than two words have no score and are never flagged; empty tables give no
rows; where the corpus' median is 0 (next to no repeated wording) there is no border and nothing is flagged; near-copies
that differ in a word count as documents of their own.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedloom.runtime import maybe_broadcast, written

BURST, REACH, HALF, SHARE, REPEATS = 2.0, 6, 0.5, 0.5, 5
#: Means are kept in steps of 1 / STEPS.
STEPS = 1000

_WORD = re.compile(r"[^\W_]+")
_LINK = re.compile(r"(?:https?://|www\.)[^\s<>\"')\]]+")
_CLOCK = re.compile(r"(?<!\d)\d\d:\d\d:\d\d(?!\d)")
_STAMP = re.compile(r"(?:\d{4}-\d\d-\d\d[t ]?)?\d\d:\d\d:\d\d(?:[.,]\d+)?(?:z|[+-]\d\d:?\d\d)?")
TEXT, LINK, LOG = 0, 1, 2
NUMBER = 1  # code of all words with a digit
#: Values of pairs are sent to the workers if a count proves them this few; beyond it they are joined.
SEND = 2_000_000
ROWS = 1_000


class _Reader:
    """Codes and kinds of a text's words; what stands between two spaces is looked up, not read again."""

    def __init__(self) -> None:
        self.known: dict[str, list[int]] = {}

    def codes(self, part: str) -> list[int]:
        import xxhash

        got = self.known.get(part)
        if got is None:
            if len(self.known) > 500_000:
                self.known.clear()
            got = self.known[part] = [xxhash.xxh64_intdigest(w) | 2 if w.isalpha() else NUMBER for w in _WORD.findall(part)]
        return got

    def read(self, text: str) -> tuple[list[int], list[int]]:
        words: list[int] = []
        kinds: list[int] = []
        lines: dict[str, int] = {}
        for line in text.lower().split("\n"):
            if line.count(":") > 1 and _CLOCK.search(line):
                start = len(words)
                for chunk in line.split():
                    words += self.codes(chunk)
                said = _STAMP.sub("", line)
                lines[said] = lines.get(said, 0) + 1
                kinds += [LOG if lines[said] <= REPEATS else TEXT] * (len(words) - start)
                continue
            for chunk in line.split():
                if ("://" in chunk or "www." in chunk):
                    at = 0
                    for m in _LINK.finditer(chunk):
                        words += self.codes(chunk[at:m.start()])
                        kinds += [TEXT] * (len(words) - len(kinds))
                        words += self.codes(m[0])
                        kinds += [LINK] * (len(words) - len(kinds))
                        at = m.end()
                    words += self.codes(chunk[at:])
                    kinds += [TEXT] * (len(words) - len(kinds))
                else:
                    words += self.codes(chunk)
            kinds += [TEXT] * (len(words) - len(kinds))
        return words, kinds


_PAGE = "doc_id bigint, copy binary, n int, ws array<bigint>, kinds array<tinyint>"


def _pages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per page of two words or more: what its copies share, its words and what each stands in."""
    import xxhash

    reader = _Reader()
    for batch in batches:
        ids, texts = batch.column("doc_id"), batch.column("text")
        for lo in range(0, batch.num_rows, ROWS):
            docs, copies, ends, flat, what = [], [], [0], [], []
            for doc, text in zip(ids[lo:lo + ROWS], texts[lo:lo + ROWS]):
                words, kinds = reader.read(text.as_py()) if text.is_valid else ([], [])
                if len(words) < 2:
                    continue
                docs.append(doc.as_py())
                copies.append(xxhash.xxh3_128_digest(np.array(words, np.uint64).tobytes() + bytes(kinds)))
                flat += words
                what += kinds
                ends.append(len(flat))
            offsets = pa.array(ends, pa.int32())
            yield pa.RecordBatch.from_arrays([
                pa.array(docs, pa.int64()), pa.array(copies, pa.binary()), pa.array(np.diff(ends).astype(np.int32)),
                pa.ListArray.from_arrays(offsets, pa.array(np.array(flat, np.uint64).view(np.int64))), pa.ListArray.from_arrays(offsets, pa.array(np.array(what, np.int8)))],
                names=["doc_id", "copy", "n", "ws", "kinds"])


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for k in range(0, batch.num_rows, ROWS):
            yield batch.slice(k, ROWS)


def _flat(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Row, word and kind at every place of a slice, and whether a pair begins there: neighbours on one page in one kind of passage."""
    lists = batch.column(batch.schema.get_field_index("ws"))
    words = lists.flatten().to_numpy(zero_copy_only=False)
    kinds = batch.column(batch.schema.get_field_index("kinds")).flatten().to_numpy(zero_copy_only=False)
    row = np.repeat(np.arange(batch.num_rows), np.diff(lists.offsets.to_numpy()))
    pair = np.zeros(len(words), bool)
    pair[:-1] = (row[1:] == row[:-1]) & (kinds[1:] == kinds[:-1]) & (kinds[:-1] != LINK)
    return row, words, kinds, pair


def code_of(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """One code for two."""
    x = (a.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + b.view(np.uint64)) * np.uint64(0xD6E8FEB86659FD93)
    return (x ^ (x >> np.uint64(29))).view(np.int64)


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(a, b, docs, times): partial sums over a slice."""
    for batch in _slices(batches):
        row, words, _, pair = _flat(batch)
        at = np.flatnonzero(pair)
        if not len(at):
            continue
        a, b, r = words[at], words[at + 1], row[at]
        u = code_of(a, b)
        order = np.argsort(u, kind="stable")  # within a pair still by row
        a, b, r, u = a[order], b[order], r[order], u[order]
        first = np.concatenate([[True], u[1:] != u[:-1]])
        doc = first | np.concatenate([[True], r[1:] != r[:-1]])
        start = np.flatnonzero(first)
        yield pa.RecordBatch.from_arrays(
            [pa.array(a[start]), pa.array(b[start]), pa.array(np.add.reduceat(doc.astype(np.int64), start)), pa.array(np.diff(np.append(start, len(u))))], names=["a", "b", "docs", "times"])


def pair_values(pages: DataFrame) -> DataFrame:
    """(a, b, v, burst): worth of every pair that two documents have, and whether it is repeated excessively."""
    stats = pages.select("ws", "kinds").mapInArrow(_counts, "a bigint, b bigint, docs bigint, times bigint").groupBy("a", "b").agg(F.sum("docs").alias("docs"), F.sum("times").alias("times"))
    stats = written(stats, "spam-pairs")
    left = written(stats.groupBy("a").agg(F.sum("docs").alias("na")), "spam-first")
    right = written(stats.groupBy("b").agg(F.sum("docs").alias("nb")), "spam-second")
    total = F.lit(float(left.agg(F.coalesce(F.sum("na"), F.lit(1))).head()[0]))
    others = F.col("docs") - 1
    kept = stats.filter("docs > 1").join(maybe_broadcast(left), "a").join(maybe_broadcast(right), "b")
    npmi = F.ln(others * total / (F.col("na") * F.col("nb"))) / -F.ln(others / total)
    return kept.select("a", "b", F.greatest(F.lit(-1.0), F.least(F.lit(1.0), npmi)).cast("float").alias("v"), (F.col("times") >= BURST * F.col("docs")).alias("burst"))


def _means(row: np.ndarray, worth: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Mean worth of the pairs around every word, in whole steps. worth: of the pair that begins at a place; counts: whether it has a part. A word among numbers only is above all borders."""
    total, parts = np.concatenate([[0.0], np.cumsum(worth * counts)]), np.concatenate([[0], np.cumsum(counts)])
    at = np.arange(len(row))
    start = np.searchsorted(row, row, side="left")
    last = np.searchsorted(row, row, side="right") - 1
    lo, hi = np.maximum(at - REACH, start), np.minimum(at + REACH, last)
    n = parts[hi] - parts[lo]
    return np.where(n > 0, np.rint((total[hi] - total[lo]) / np.maximum(n, 1) * STEPS), STEPS).astype(np.int16)


_MEANS = "doc_id bigint, n int, means array<smallint>"


def _score(values):
    """Means of a page's words; values: a broadcast of sorted pair codes, their worth and bursts, or None where rows bring their own."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            row, words, kinds, pair = _flat(batch)
            at = np.flatnonzero(pair)
            u = code_of(words[at], words[at + 1])
            if values is not None:
                known, v, burst = values.value
            else:
                own = batch.column(batch.schema.get_field_index("own")).flatten()
                known, first = np.unique(code_of(*[own.field(c).to_numpy(zero_copy_only=False) for c in ("a", "b")]), return_index=True)
                v, burst = own.field("v").to_numpy(zero_copy_only=False)[first], own.field("burst").to_numpy(zero_copy_only=False)[first]
            worth = np.zeros(len(words))
            if len(known):
                k = np.minimum(np.searchsorted(known, u), len(known) - 1)
                speaks = (known[k] == u) & (~burst[k] | (kinds[at] == LOG))
                worth[at] = np.where(speaks, v[k], 0.0)
            counts = np.ones(len(words), np.int64)
            counts[:-1] = (words[:-1] != NUMBER) | (words[1:] != NUMBER)
            lists = batch.column(batch.schema.get_field_index("ws"))
            offsets = lists.offsets.to_numpy()
            means = pa.ListArray.from_arrays(pa.array(offsets - offsets[0], pa.int32()), pa.array(_means(row, worth, counts)))
            yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index("doc_id")), batch.column(batch.schema.get_field_index("n")), means], names=["doc_id", "n", "means"])

    return run


def without_copies(pages: DataFrame) -> DataFrame:
    """One page of each group of copies, the one with the smallest id."""
    many = written(pages.groupBy("copy").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")).filter("n > 1").select("copy", "first"), "spam-copies")
    extra = written(pages.select("doc_id", "copy").join(maybe_broadcast(many), "copy").filter("doc_id <> first").select("doc_id"), "spam-extra")
    return pages.join(maybe_broadcast(extra), "doc_id", "left_anti")


def page_scores(docs: DataFrame, send: int = SEND) -> DataFrame:
    """(doc_id, n_words, mean, share): mean worth of a page's words, and the share of them in keyword, link and tag passages."""
    pages = written(docs.select("doc_id", "text").mapInArrow(_pages, _PAGE), "spam-pages")
    values = written(pair_values(without_copies(pages)), "spam-values")
    slim = pages.select("doc_id", "n", "ws", "kinds")
    if values.count() <= send:
        t = values.toPandas()
        u = code_of(t["a"].to_numpy(np.int64), t["b"].to_numpy(np.int64))
        order = np.argsort(u)
        sent = docs.sparkSession.sparkContext.broadcast((u[order], t["v"].to_numpy(np.float32)[order], t["burst"].to_numpy(bool)[order]))
        means = slim.mapInArrow(_score(sent), _MEANS)
    else:
        said = pages.select("doc_id", F.explode(F.arrays_zip(F.slice("ws", 1, F.size("ws") - 1).alias("a"), F.slice("ws", 2, F.size("ws") - 1).alias("b"))).alias("p")).select("doc_id", "p.a", "p.b").distinct()
        own = said.join(values, ["a", "b"]).groupBy("doc_id").agg(F.collect_list(F.struct("a", "b", "v", "burst")).alias("own"))
        whole = slim.join(own, "doc_id", "left").withColumn("own", F.coalesce("own", F.expr("cast(array() as array<struct<a:bigint,b:bigint,v:float,burst:boolean>>)")))
        means = whole.mapInArrow(_score(None), _MEANS)
    means = written(means, "spam-means")
    levels = means.select(F.explode("means").alias("m")).groupBy("m").agg(F.count("*").alias("n")).orderBy("m").toPandas()  # at most 2 * STEPS + 1 rows
    border = 0.0
    if len(levels):
        border = HALF * float(levels["m"][np.searchsorted(np.cumsum(levels["n"]), levels["n"].sum() / 2)])
    low = F.size(F.filter("means", lambda m: m < border)) / F.col("n") if border > 0 else F.lit(0.0)
    mean = F.aggregate("means", F.lit(0).cast("bigint"), lambda s, m: s + m) / F.col("n") / STEPS
    return means.select("doc_id", F.col("n").alias("n_words"), mean.alias("mean"), low.alias("share"))


def spam_pages(docs: DataFrame) -> DataFrame:
    return page_scores(docs).filter(F.col("share") > SHARE).select("doc_id")
