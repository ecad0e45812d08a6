"""Tokens with their counts per text, in Arrow batches: each distinct word is stemmed once, not each occurrence."""

from __future__ import annotations

import re
from collections import Counter
from itertools import chain

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedloom.functions.text import STOPWORDS

_WORD, _ES, _DOUBLE = re.compile(r"[a-z0-9]+"), re.compile(r"(?:ch|sh|x|z|s)es$"), re.compile(r"([^aeiou])\1$")
#: Words whose stems are remembered at once.
REMEMBERED = 500_000


def stem(word: str) -> str:
    """As text.stem."""
    n = len(word)
    if n <= 3:
        return word
    if n > 4 and word.endswith("ies"):
        return word[:-3] + "y"
    if word.endswith("sses") or n > 4 and (word.endswith("ses") or _ES.search(word)):
        return word[:-2]
    if word.endswith("s") and not word.endswith(("ss", "us")):
        return word[:-1]
    base = word[:-3] if word.endswith("ing") and n > 5 else word[:-2] if word.endswith("ed") and n > 4 else None
    if base is None:
        return word
    return base[:-1] if _DOUBLE.search(base) else base


def token_bags(docs: DataFrame, doc: str, text: str, *beside: str) -> DataFrame:
    """(doc, beside, terms ARRAY, tf ARRAY): the tokens of text.tokenize with their counts, in order of first occurrence.

    One row a doc, texts of one doc taken together; with columns beside, one for each row.
    """
    import pyarrow as pa

    docs = docs.select(doc, text, *beside)
    if not beside and not docs.groupBy(doc).agg(F.count("*").alias("n")).filter("n > 1").isEmpty():
        docs = docs.groupBy(doc).agg(F.concat_ws(" ", F.collect_list(text)).alias(text))
    stopwords, own = frozenset(STOPWORDS), [doc, *beside]

    def run(batches):
        known: dict[str, str] = {}
        for batch in batches:
            bags = []
            for t in batch.column(1).to_pylist():
                bag: dict[str, int] = {}
                for w, n in Counter(_WORD.findall((t or "").lower())).items():
                    s = known.get(w)
                    if s is None:
                        if len(known) >= REMEMBERED:
                            known.clear()
                        s = known[w] = "" if len(w) < 3 or w in stopwords else stem(w)
                    if s:
                        bag[s] = bag.get(s, 0) + n
                bags.append(bag)
            ends = pa.array([0, *_running(map(len, bags))], pa.int32())
            terms, tf = pa.array(list(chain.from_iterable(bags)), pa.string()), pa.array(list(chain.from_iterable(b.values() for b in bags)), pa.int32())
            yield pa.RecordBatch.from_arrays([*map(batch.column, own), pa.ListArray.from_arrays(ends, terms), pa.ListArray.from_arrays(ends, tf)], [*own, "terms", "tf"])

    kinds = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in own)
    return docs.mapInArrow(run, f"{kinds}, terms array<string>, tf array<int>")


def _running(sizes) -> list[int]:
    out, total = [], 0
    for n in sizes:
        total += n
        out.append(total)
    return out
