"""Records grouped into clusters about one issue, each with its size and most typical members.

A record mixes statements of its issue, in one of many wordings, with remarks that go with any issue. Two properties
tell them apart. Words of the issue come again in other clauses of the same record far more often than chance, remarks
do not (adaptation: the second occurrence of a topical word is far likelier than the first). And words of one issue keep
each other's company. So:

1. Terms are words of four letters or more and pairs of neighbouring words within a clause; numbers are left out. A term
   is topical if it recurs in another clause of its records LIFT times as often as chance gives, with certainty SURE; of
   a frequent term (HOT of all records), whose chance is high already, it is enough to recur as often as chance gives.
2. Topical terms that share records more often than chance are linked with their normalised pointwise mutual information:
   a sparse graph of the collection's wording, whose size is that of the vocabulary, not of the records.
3. Average linkage by reciprocal nearest neighbours (linkage.py) merges all mutual best pairs of each round until none
   reaches THRESHOLD.
4. A clause speaks for a cluster if its terms' mean links into the cluster sum to one. A cluster is an issue if clauses
   of it come again in a record TOPIC times as often as chance gives: set phrases, whose words keep company but never
   recur, are dropped.
5. A record belongs to the issue its terms speak for most, if they sum to one like a clause's. All others are clustered by
   their wording (numbers aside), so machine messages are issues of their own and no record with a word is left out.

Records with the same topical clauses form one class: pairs, tests and votes run once per class, weighted by its size;
records of the same wording count once in all statistics. Pairs are formed within a class's terms, never from lists of a
term's records, so a hot term or issue is no hot key. The topical terms go to the workers if a count proves them few
(SEND) and are joined otherwise; both ways give the same rows.

Defined results: null and wordless texts have a null cluster; ties go to the larger issue, then to the smaller id; an
empty table gives no rows; other columns are ignored; rec is unique.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from feedloom.operators.linkage import average_linkage
from feedloom.runtime import maybe_broadcast, written

MIN_RECORDS, LIFT, SURE, HOT, HOT_RECURS = 3, 3.0, 2.0, 0.01, 5
MIN_SHARED, LINK_LIFT, LINK_SURE, THRESHOLD = 2, 2.0, 3.0, 0.15
SPEAKS, TOPIC, TOPIC_SURE = 1.0, 1.5, 3.0
#: Topical terms are sent to the workers if a count proves them this few; beyond it they are joined.
SEND = 2_000_000

NUMBER, END = 0, 1  # marks in a token stream; all other codes are words, odd ones of four letters or more
_WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*")
_HAS_DIGIT = re.compile(r"[\d@]")
ROWS = 2_000


def _codes_of(chunk: str) -> list[int]:
    """Codes of what stands between two spaces: its words, or one number mark, and clause ends before and after."""
    import xxhash

    if chunk == "-":
        return [END]
    out = [END] if chunk[0] in ">(" else []
    if _HAS_DIGIT.search(chunk):
        out.append(NUMBER)
    else:
        out += [(xxhash.xxh64_intdigest(w) & ~1) | (len(w) >= 4) for w in _WORD.findall(chunk)]
    if chunk[-1] in ".!?;:,)>":
        out.append(END)
    return out


def _tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Token streams of texts, and sig, which texts of the same words in the same order share (null without a word)."""
    import xxhash

    known: dict[str, list[int]] = {}
    for batch in batches:
        texts = batch.column("text")
        flat: list[int] = []
        ends = [0]
        sigs: list[int | None] = []
        for t in texts:
            start = len(flat)
            if t.is_valid:
                for chunk in t.as_py().lower().replace("\n", " > ").split():
                    codes = known.get(chunk)
                    if codes is None:
                        if len(known) > 500_000:
                            known.clear()
                        codes = known[chunk] = _codes_of(chunk)
                    flat += codes
            words = [c for c in flat[start:] if c > END]
            sigs.append(xxhash.xxh3_64_intdigest(np.array(words, np.uint64).tobytes()) if words else None)
            ends.append(len(flat))
        ws = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.array(flat, np.uint64).view(np.int64)))
        sig = pa.array([None if s is None else s - (1 << 64) if s >> 63 else s for s in sigs], pa.int64())
        yield pa.RecordBatch.from_arrays([batch.column("rec"), batch.column("rid"), sig, ws], names=["rec", "rid", "sig", "ws"])


def token_streams(records: DataFrame) -> DataFrame:
    """(rec, rid, sig, ws), written once: texts are read a single time."""
    slim = records.select("rec", F.xxhash64("rec").alias("rid"), "text")
    return written(slim.mapInArrow(_tokens, "rec string, rid long, sig long, ws array<long>"), "iss-words")


def _terms(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, clause (ascending) and code of every term of a slice of token streams."""
    lists = batch.column(batch.schema.get_field_index("ws"))
    flat = lists.flatten().to_numpy(zero_copy_only=False)
    lengths = np.diff(lists.offsets.to_numpy())
    row = np.repeat(np.arange(len(lengths)), lengths)
    new = np.ones(len(flat), bool)
    new[1:] = (row[1:] != row[:-1]) | (flat[:-1] == END)
    clause = np.cumsum(new)
    word = (flat != NUMBER) & (flat != END)
    one = np.flatnonzero(word & ((flat & 1) == 1))
    two = np.flatnonzero(word[:-1] & word[1:] & (row[:-1] == row[1:]))
    u = flat.view(np.uint64)
    pair = (u[two] * np.uint64(0x9E3779B97F4A7C15) + u[two + 1]) * np.uint64(0xD6E8FEB86659FD93)
    pair ^= pair >> np.uint64(29)
    at = np.concatenate([one, two])
    code = np.concatenate([flat[one], pair.view(np.int64)])
    order = np.argsort(at, kind="stable")
    at = at[order]
    return row[at], clause[at], code[order]


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for k in range(0, batch.num_rows, ROWS):
            yield batch.slice(k, ROWS)


def _sum_by(keys: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, ...]:
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys[first], *[np.add.reduceat(v[order], first) if len(first) else v for v in values]


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Partial sums: in how many records a term is, and in how many in two clauses or more."""
    parts: list[tuple[np.ndarray, ...]] = []
    held = 0

    def fold() -> tuple[np.ndarray, ...]:
        return _sum_by(*[np.concatenate(x) for x in zip(*parts)])

    def out(t, f, r) -> Iterator[pa.RecordBatch]:
        for k in range(0, len(t), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(x[k:k + 100_000]) for x in (t, f, r)], names=["term", "f", "r"])

    for batch in _slices(batches):
        row, clause, code = _terms(batch)
        order = np.argsort(code, kind="stable")  # within a term still by row and clause
        row, clause, code = row[order], clause[order], code[order]
        if not len(code):
            continue
        new_term = np.concatenate([[True], code[1:] != code[:-1]])
        new_row = new_term | np.concatenate([[True], row[1:] != row[:-1]])
        new_clause = new_row | np.concatenate([[True], clause[1:] != clause[:-1]])
        rows = np.flatnonzero(new_row)
        again = np.add.reduceat(new_clause.astype(np.int64), rows) > 1
        first = np.flatnonzero(new_term[rows])
        parts.append((code[rows][first], np.diff(np.append(first, len(rows))), np.add.reduceat(again.astype(np.int64), first)))
        held += len(first)
        if held > 4_000_000:
            parts = [fold()]
            held = len(parts[0][0])
            if held > 2_000_000:
                yield from out(*parts.pop())
                held = 0
    if parts:
        yield from out(*fold())


def _surer(k: Column, chance: Column) -> Column:
    """Log-likelihood ratio of k against a Poisson expectation, for k above it."""
    return k * F.ln(k / chance) - k + chance


def topical_terms(streams: DataFrame, total: int) -> DataFrame:
    """(term, f) of the topical terms of records that count (one per wording)."""
    n = F.lit(float(max(total, 1)))
    t = streams.select("ws").mapInArrow(_counts, "term long, f long, r long").groupBy("term").agg(F.sum("f").alias("f"), F.sum("r").alias("r"))
    chance = F.col("f") * F.col("f") / n
    rare = (F.col("r") >= LIFT * chance) & (_surer(F.col("r"), chance) >= SURE)
    hot = (F.col("f") >= HOT * n) & (F.col("r") >= F.greatest(chance, F.lit(HOT_RECURS)))
    return written(t.filter((F.col("f") >= MIN_RECORDS) & (F.col("r") >= 1) & (rare | hot)).select("term", "f"), "iss-terms")


_CLASS = "rid long, sig long, cls long, cs array<array<long>>"


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(29))


def _class_rows(n: int, row: np.ndarray, clause: np.ndarray, code: np.ndarray) -> tuple[pa.Array, pa.Array]:
    """Class hash (null without a topical term) and the topical terms by clause, of n rows. A class does not depend on the order of its clauses."""
    order = np.lexsort((code, clause))
    row, clause, code = row[order], clause[order], code[order]
    if len(code):
        keep = np.concatenate([[True], (code[1:] != code[:-1]) | (clause[1:] != clause[:-1])])
        row, clause, code = row[keep], clause[keep], code[keep]
    starts = np.flatnonzero(np.concatenate([[True], clause[1:] != clause[:-1]])) if len(code) else np.zeros(0, np.int64)
    has = np.zeros(n, bool)
    cls = np.zeros(n, np.uint64)
    owner = row[starts]
    if len(starts):
        said = _mix(np.add.reduceat(_mix(code.view(np.uint64)), starts))
        first = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
        has[owner[first]] = True
        cls[owner[first]] = np.add.reduceat(said, first)
    inner = pa.ListArray.from_arrays(pa.array(np.append(starts, len(code)), pa.int32()), pa.array(code))
    outer = np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=n))])
    return pa.array(cls.view(np.int64), mask=~has), pa.ListArray.from_arrays(pa.array(outer, pa.int32()), inner)


def _to_classes(topical):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = topical.value
        for batch in _slices(batches):
            row, clause, code = _terms(batch)
            at = np.minimum(np.searchsorted(known, code), max(len(known) - 1, 0))
            hit = known[at] == code if len(known) else np.zeros(len(code), bool)
            cls, cs = _class_rows(batch.num_rows, row[hit], clause[hit], code[hit])
            yield pa.RecordBatch.from_arrays([batch.column("rid"), batch.column("sig"), cls, cs], names=["rid", "sig", "cls", "cs"])

    return run


def _exploded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row per term; every record begins with a row without one, so that none is lost in the join."""
    for batch in _slices(batches):
        row, clause, code = _terms(batch)
        rid = batch.column("rid").to_numpy(zero_copy_only=False)
        yield pa.RecordBatch.from_arrays([pa.array(rid[row]), pa.array(clause.astype(np.int32)), pa.array(code)], names=["rid", "clause", "term"])


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in _slices(batches):
        lists = batch.column("ts")
        flat = lists.flatten()
        lengths = np.diff(lists.offsets.to_numpy())
        row = np.repeat(np.arange(len(lengths)), lengths)
        clause, code = flat.field("clause").to_numpy(zero_copy_only=False).astype(np.int64), flat.field("term").to_numpy(zero_copy_only=False)
        order = np.lexsort((clause, row))
        row, clause, code = row[order], clause[order], code[order]
        new = np.ones(len(row), bool)
        new[1:] = (row[1:] != row[:-1]) | (clause[1:] != clause[:-1])
        cls, cs = _class_rows(batch.num_rows, row, np.cumsum(new), code)
        yield pa.RecordBatch.from_arrays([batch.column("rid"), batch.column("sig"), cls, cs], names=["rid", "sig", "cls", "cs"])


def classes_of(streams: DataFrame, terms: DataFrame, send: int = SEND) -> DataFrame:
    """(rid, sig, cls, cs): each record's class and topical terms by clause."""
    slim = streams.select("rid", "sig", "ws")
    if terms.count() <= send:
        known = streams.sparkSession.sparkContext.broadcast(np.sort(terms.select("term").toPandas()["term"].to_numpy(np.int64)))
        return slim.mapInArrow(_to_classes(known), _CLASS)
    ts = slim.mapInArrow(_exploded, "rid long, clause int, term long").join(terms.select("term"), "term").groupBy("rid").agg(F.collect_list(F.struct("clause", "term")).alias("ts"))
    whole = slim.select("rid", "sig").join(ts, "rid", "left").withColumn("ts", F.coalesce("ts", F.expr("cast(array() as array<struct<clause:int,term:bigint>>)")))
    return whole.mapInArrow(_gathered, _CLASS)


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(a, b, c): partial counts of records that two topical terms share."""
    import pandas as pd

    held: list[np.ndarray] = []
    size = 0

    def out() -> pa.RecordBatch:
        a, b, c = (np.concatenate(x) for x in zip(*held))
        s = pd.DataFrame({"a": a, "b": b, "c": c}).groupby(["a", "b"], sort=False)["c"].sum().reset_index()
        held.clear()
        return pa.RecordBatch.from_pandas(s, preserve_index=False)

    for batch in batches:
        weight = batch.column("m").to_pylist()
        for m, clauses in zip(weight, batch.column("cs")):
            ts = np.unique(clauses.values.flatten().to_numpy(zero_copy_only=False))
            for i in range(0, len(ts), 512):  # a very long record's pairs leave in pieces
                x, y = np.nonzero(ts[i:i + 512, None] < ts[None, :])
                held.append((ts[i:i + 512][x], ts[y], np.full(len(x), m, np.int64)))
                size += len(x)
                if size > 500_000:
                    yield out()
                    size = 0
    if held:
        yield out()


def clusters(records: DataFrame, threshold: float = THRESHOLD, send: int = SEND) -> DataFrame:
    """(rec, cluster, score) of records (rec STRING, text STRING), one row per record."""
    streams = token_streams(records)
    again = streams.filter("sig IS NOT NULL").groupBy("sig").agg(F.min("rid").alias("first"), F.count("*").alias("n"))
    many = written(again.filter("n > 1").select("sig", "first"), "iss-copies")
    extra = written(streams.select("rid", "sig").join(maybe_broadcast(many), "sig").filter("rid <> first").select("rid"), "iss-extra")
    extra_rows = extra.count()
    once = streams.filter("sig IS NOT NULL").join(maybe_broadcast(extra, extra_rows), "rid", "left_anti")
    total = streams.filter("sig IS NOT NULL").count() - extra_rows
    terms = topical_terms(once, total)
    rows = written(classes_of(streams, terms, send), "iss-classes")

    spoken = rows.filter("cls IS NOT NULL")
    size = spoken.select("rid", "cls").join(maybe_broadcast(extra, extra_rows), "rid", "left_anti").groupBy("cls").agg(F.min("rid").alias("rid"), F.count("*").alias("m"))
    classes = written(spoken.select("rid", "cls", "cs").join(size, ["rid", "cls"]).select("cls", "cs", "m"), "iss-class")

    n = F.lit(float(max(total, 1)))
    shared = classes.select("m", "cs").mapInArrow(_pairs, "a long, b long, c long").groupBy("a", "b").agg(F.sum("c").alias("c"))
    term_rows = terms.count()
    for end in ("a", "b"):
        shared = shared.join(maybe_broadcast(terms.select(F.col("term").alias(end), F.col("f").alias(f"f{end}")), term_rows), end)
    chance = F.col("fa") * F.col("fb") / n
    strong = (F.col("c") >= MIN_SHARED) & (F.col("c") >= LINK_LIFT * chance) & (_surer(F.col("c"), chance) >= LINK_SURE)
    near = F.when(F.col("c") >= n, 1.0).otherwise(F.ln(F.col("c") / chance) / -F.ln(F.col("c") / n))
    links = written(shared.filter(strong).select("a", "b", near.alias("sim")), "iss-links")

    label = written(average_linkage(links, threshold).withColumnsRenamed({"id": "term"}), "iss-labels")
    mates = label.groupBy("cluster").agg((F.count("*") - 1).alias("mates")).filter("mates > 0")
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"), "sim"))
    inside = both.join(label.withColumnsRenamed({"term": "a", "cluster": "cluster"}), "a").join(label.withColumnsRenamed({"term": "b", "cluster": "cb"}), "b").filter("cluster = cb")
    weight = inside.groupBy(F.col("a").alias("term"), "cluster").agg(F.sum("sim").alias("s")).join(mates, "cluster").select("term", "cluster", (F.col("s") / F.col("mates")).alias("w"))
    weight = written(weight, "iss-weights")

    said = classes.select("cls", "m", F.posexplode("cs").alias("at", "ts")).select("cls", "m", "at", F.explode("ts").alias("term")).join(maybe_broadcast(weight), "term")
    clause = said.groupBy("cls", "cluster", "at").agg(F.sum("w").alias("w"), F.first("m").alias("m"))
    voice = clause.groupBy("cls", "cluster").agg(F.sum("w").alias("score"), F.count_if(F.round("w", 9) >= SPEAKS).alias("k"), F.first("m").alias("m"))
    voice = written(voice, "iss-voices")
    spoken_in = voice.filter("k > 0").groupBy("cluster").agg(F.sum("m").alias("f"), F.sum(F.when(F.col("k") > 1, F.col("m")).otherwise(0)).alias("r"))
    expected = F.col("f") * F.col("f") / n
    issues = spoken_in.filter((F.col("r") >= 2) & (F.col("r") >= TOPIC * expected) & (_surer(F.col("r"), expected) >= TOPIC_SURE)).select("cluster", "f")
    order = F.struct(F.round("score", 9).alias("score"), "f", (-F.col("cluster")).alias("c"))
    heard = voice.filter(F.round("score", 9) >= SPEAKS)
    named = heard.join(maybe_broadcast(written(issues, "iss-issues")), "cluster").groupBy("cls").agg(F.max(order).alias("v"))
    named = written(named.select("cls", (-F.col("v.c")).alias("cluster"), F.col("v.score").alias("score")), "iss-named")

    found = rows.select("rid", "sig", "cls").join(maybe_broadcast(named), "cls", "left")
    found = found.select("rid", F.coalesce("cluster", "sig").alias("cluster"), F.when(F.col("sig").isNotNull(), F.coalesce("score", F.lit(0.0))).alias("score"))
    return streams.select("rec", "rid").join(found, "rid").select("rec", "cluster", "score")


def summary(clustered: DataFrame, records: DataFrame, members: int = 3, salts: int = 64) -> DataFrame:
    """(cluster, size, typical): size and the most typical members' texts; top members are found in two steps, so a hot cluster is never one task's sort."""
    has = clustered.filter("cluster IS NOT NULL")
    size = has.groupBy("cluster").agg(F.count("*").alias("size"))
    salt = F.pmod(F.xxhash64("rec"), F.lit(salts))
    part = W.partitionBy("cluster", "salt").orderBy(F.desc("score"), "rec")
    top = has.withColumn("salt", salt).withColumn("k", F.row_number().over(part)).filter(F.col("k") <= members)
    whole = W.partitionBy("cluster").orderBy(F.desc("score"), "rec")
    top = top.drop("k").withColumn("k", F.row_number().over(whole)).filter(F.col("k") <= members).select("cluster", "k", "rec")
    texts = records.select("rec", "text").join(maybe_broadcast(top), "rec").groupBy("cluster").agg(F.array_sort(F.collect_list(F.struct("k", "rec", "text"))).alias("typical"))
    return size.join(texts, "cluster", "left")
