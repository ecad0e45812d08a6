"""Order-dependent leader-follower clustering, and simple baselines.

Leader-follower is sequential by definition: a record joins the best existing cluster or founds one, so its result
depends on all before it in its project. Projects run in parallel; within one, records stream through in order and only
the clusters' sums are held, never the records. There is no exact parallel form within a project.
"""

from __future__ import annotations

import json
import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedloom.functions.text import top_content_word


STATE_VERSION = 1


@dataclass
class _Cluster:
    size: int = 0
    dense: list[float] | None = None
    dense_n: int = 0
    keys: dict[str, int] = field(default_factory=dict)

    def add(self, key: str, dense) -> None:
        self.size += 1
        self.keys[key] = self.keys.get(key, 0) + 1
        if dense is not None:
            self.dense = list(dense) if self.dense is None else [a + b for a, b in zip(self.dense, dense)]
            self.dense_n += 1


class _Postings:
    """A term's clusters and its weight in the sum of each, as arrays that grow."""

    __slots__ = ("ids", "sums", "n", "at")

    def __init__(self) -> None:
        self.ids, self.sums, self.n, self.at = np.zeros(4, np.int64), np.zeros(4), 0, {}

    def add(self, cluster: int, w: float) -> float:
        """Adds to a cluster's weight and returns what it was."""
        k = self.at.get(cluster)
        if k is None:
            if self.n == len(self.ids):
                self.ids, self.sums = np.resize(self.ids, 2 * self.n), np.concatenate([self.sums, np.zeros(self.n)])
            k = self.at[cluster] = self.n
            self.ids[k], self.n = cluster, self.n + 1
        old = float(self.sums[k])
        self.sums[k] = old + w
        return old


class Leader:
    """State of one project's clustering. With idf=None the idf is that of the moment of arrival.

    The clusters' sums are kept by term (an inverted index), so a record is held against all clusters it shares a term
    with by one array operation per term.
    """

    def __init__(self, threshold: float, structural_bonus: float = 0.0, semantic_weight: float = 0.0, idf: dict[str, float] | None = None):
        self.threshold, self.bonus, self.semantic = threshold, structural_bonus, min(max(semantic_weight, 0.0), 1.0)
        self.idf = idf
        self.clusters: list[_Cluster] = []
        self.index: dict[str, _Postings] = {}
        self.norm2 = np.zeros(16)
        self.df: dict[str, int] = {}
        self.n = 0

    def vectorise(self, tokens: list[str] | dict[str, int]) -> dict[str, float]:
        """tokens: in order, or their counts in order of first occurrence."""
        tf = tokens if isinstance(tokens, dict) else Counter(tokens)
        self.n += 1
        for t in tf:
            self.df[t] = self.df.get(t, 0) + 1
        weight = (lambda t: self.idf.get(t)) if self.idf is not None else (lambda t: math.log(1 + self.n / (1 + self.df[t])))
        raw = {t: (1 + math.log(c)) * w for t, c in tf.items() if (w := weight(t)) is not None}
        length = math.sqrt(sum(w * w for w in raw.values()))
        return {t: w / length for t, w in raw.items()} if length else raw

    def _lexical(self, vec: dict[str, float]) -> np.ndarray:
        """Cosine to every cluster's sum."""
        met = [(p, w) for t, w in vec.items() if (p := self.index.get(t)) is not None]
        dots = np.zeros(len(self.clusters))
        if met:  # each cluster's products are added in order of the record's terms
            each = np.repeat([w for _, w in met], [p.n for p, _ in met])
            dots = np.bincount(np.concatenate([p.ids[:p.n] for p, _ in met]), each * np.concatenate([p.sums[:p.n] for p, _ in met]), len(dots))
        norm2 = self.norm2[:len(dots)]
        return np.divide(dots, np.sqrt(norm2), out=np.zeros(len(dots)), where=norm2 > 0)

    def assign(self, tokens: list[str] | dict[str, int], key: str = "", dense=None) -> tuple[int, float]:
        """(cluster number, similarity); a founder's similarity is 0."""
        vec = self.vectorise(tokens)
        best, best_score = -1, -1.0
        scores = self._lexical(vec)
        if not self.bonus and not self.semantic:
            if vec and len(scores):
                best = int(np.argmax(scores))  # the first of equals
                best_score = float(scores[best])
        else:
            for c, cl in enumerate(self.clusters):
                score, signal = float(scores[c]), bool(vec)
                if self.semantic and dense is not None and cl.dense is not None:
                    d = sum(a * b for a, b in zip(dense, cl.dense))
                    nn = math.sqrt(sum(a * a for a in dense)) * math.sqrt(sum(b * b for b in cl.dense))
                    score = (1 - self.semantic) * score + self.semantic * (d / nn if nn else 0.0)
                    signal = True
                if self.bonus:
                    score += self.bonus * cl.keys.get(key, 0) / cl.size
                if signal and score > best_score:
                    best, best_score = c, score
        if best < 0 or best_score < self.threshold:
            self.clusters.append(_Cluster())
            best, best_score = len(self.clusters) - 1, 0.0
            if best == len(self.norm2):
                self.norm2 = np.concatenate([self.norm2, np.zeros(best)])
        self.clusters[best].add(key, dense)
        grown = 0.0
        for t, w in vec.items():
            old = self.index.setdefault(t, _Postings()).add(best, w)
            grown += 2 * old * w + w * w
        self.norm2[best] += grown
        return best, best_score


    def to_json(self) -> str:
        """The whole state; a restored one assigns as this one would."""
        return json.dumps({
            "version": STATE_VERSION, "threshold": self.threshold, "bonus": self.bonus, "semantic": self.semantic, "idf": self.idf, "n": self.n, "df": self.df, "norm2": self.norm2[:len(self.clusters)].tolist(),
            "clusters": [[c.size, c.keys, c.dense, c.dense_n] for c in self.clusters], "index": {t: [p.ids[:p.n].tolist(), p.sums[:p.n].tolist()] for t, p in self.index.items()}})

    @classmethod
    def from_json(cls, text: str) -> Leader:
        d = json.loads(text)
        if d.get("version") != STATE_VERSION:
            raise ValueError(f"state of version {d.get('version')}, expected {STATE_VERSION}")
        out = cls(d["threshold"], d["bonus"], d["semantic"], d["idf"])
        out.n, out.df = d["n"], d["df"]
        out.clusters = [_Cluster(size, dense, dense_n, keys) for size, keys, dense, dense_n in d["clusters"]]
        out.norm2 = np.concatenate([np.array(d["norm2"], np.float64), np.zeros(max(16, len(d["norm2"])))])
        for t, (ids, sums) in d["index"].items():
            p = out.index[t] = _Postings()
            p.ids, p.sums, p.n, p.at = np.array(ids, np.int64), np.array(sums, np.float64), len(ids), {c: k for k, c in enumerate(ids)}
        return out


def _lists(column) -> Iterator[list]:
    """The lists of an Arrow list array; a null one is empty."""
    import pyarrow.compute as pc

    flat = pc.list_flatten(column).to_numpy(zero_copy_only=False).tolist()
    ends = np.cumsum(pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)).tolist()
    return (flat[a:b] for a, b in zip([0, *ends], ends))


def leader_follower(docs: DataFrame, *, threshold: float = 0.25, structural_bonus: float = 0.0, semantic_weight: float = 0.0, group: str = "project_id", idf: DataFrame | None = None, beside: tuple[str, ...] = ()) -> DataFrame:
    """(project_id, id, cluster_id, similarity, seq, beside) of docs (project_id, id, tokens, key, vector, seq), assigned in order of seq.

    Instead of tokens docs may have terms and tf, as of bags.token_bags; key and vector may be absent. beside: further
    columns of docs that stay. idf (group, term, idf) gives the weights of the whole corpus; without it they are those of
    the moment of arrival. A project's weights travel with its records, as its vocabulary is part of the state its task
    holds anyway.
    """
    import pyarrow as pa

    read = [c for c in (group, "tokens", "terms", "tf", "key", "vector", "idf_") if c in docs.columns or c == "idf_" and idf is not None]
    if idf is not None:
        # a leading row per project holds its weights; its place in the order is before all records
        heads = idf.groupBy(group).agg(F.map_from_entries(F.collect_list(F.struct("term", "idf"))).alias("idf_"))
        lead = docs.limit(0).drop("seq").unionByName(heads.select(group, "idf_"), allowMissingColumns=True).withColumn("seq", F.lit(None).cast("bigint"))
        docs = docs.unionByName(lead, allowMissingColumns=True)
    has_idf = idf is not None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, leader = object(), None
        for batch in batches:
            labels, scores, kept = [], [], []
            lists = {c: _lists(batch.column(c)) if c in ("terms", "tf") else batch.column(c).to_pylist() for c in read}
            none = [None] * batch.num_rows
            bags = (dict(zip(t, n)) for t, n in zip(lists["terms"], lists["tf"])) if "terms" in lists else lists["tokens"]
            for g, bag, key, vector, weights in zip(lists[group], bags, lists.get("key", none), lists.get("vector", none), lists.get("idf_", none)):
                if g != now:
                    now, leader = g, Leader(threshold, structural_bonus, semantic_weight, {} if has_idf else None)
                kept.append(weights is None)
                if weights is not None:
                    leader.idf = dict(weights)
                    continue
                c, s = leader.assign(bag if bag is not None else [], key or "", vector)
                labels.append(f"c{c}")
                scores.append(float(s))
            rows = batch if all(kept) else batch.filter(pa.array(kept, pa.bool_()))
            yield pa.RecordBatch.from_arrays([rows.column(group), rows.column("id"), pa.array(labels, pa.string()), pa.array(scores, pa.float64()), *[rows.column(c) for c in ("seq", *beside)]], [group, "id", "cluster_id", "similarity", "seq", *beside])

    ordered = docs.repartition(group).sortWithinPartitions(group, "seq")
    kinds = "".join(f", `{c}` {docs.schema[c].dataType.simpleString()}" for c in beside)
    return ordered.mapInArrow(run, f"{group} string, id string, cluster_id string, similarity double, seq bigint{kinds}")


def structural_key(platform: Column, route: Column, version: Column) -> Column:
    return F.concat_ws("|", *[F.coalesce(c, F.lit("")) for c in (platform, route, version)])


def structural(platform: Column, route: Column, version: Column, ts: Column, days: int = 7) -> Column:
    """Baseline label: platform, route, version and a bucket of days counted from the epoch."""
    bucket = F.floor(F.unix_micros(ts) / F.lit(86_400_000_000 * days)).cast("string")
    return F.concat(F.lit("st:"), structural_key(platform, route, version), F.lit("|"), bucket)


def all_one(ids: DataFrame) -> DataFrame:
    """Baseline: everything in one cluster."""
    return ids.select("id", F.lit("c0").alias("label"))


def all_singletons(ids: DataFrame) -> DataFrame:
    """Baseline: every record a cluster of its own."""
    return ids.select("id", F.col("id").cast("string").alias("label"))


def structural_token(platform: Column, route: Column, version: Column, ts: Column, text: Column, days: int = 7) -> Column:
    """Baseline label: the structural one and the text's longest content word."""
    return F.concat(structural(platform, route, version, ts, days), F.lit("|"), top_content_word(text))
