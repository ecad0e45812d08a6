"""Greedy sequential folds over event streams: bursts, rage clicks, frustration signals, a sliding-window rate limiter.

Which events a burst consumes depends on the bursts before it, so these are folds in order of time. Rows are spread by
key, sorted by Spark (which spills) and streamed through; the state held per key is a window of recent events.
"""

from __future__ import annotations

import math
from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Weight of each signal; burst rules as (event kind, events, milliseconds).
WEIGHTS = {"dead_click": 0.35, "rage_click": 0.3, "form_error_repeat": 0.25, "reload": 0.2, "console_error_spike": 0.2, "nav_thrash": 0.15, "escape_mash": 0.15, "scroll_thrash": 0.05}
BURSTS = {"nav_thrash": ("nav", 4, 10_000), "escape_mash": ("escape", 3, 2_000), "console_error_spike": ("console_error", 3, 5_000)}
SCROLL = (4, 5_000)
RAGE_CLICKS, RAGE_MS, RAGE_RADIUS = 3, 1_000, 30.0
FORM_ERRORS = 2
PROMPT_AT = 0.5


class Burst:
    """Counts non-overlapping windows of less than `ms` that hold `need` events or more, event by event in order."""

    def __init__(self, need: int, ms: int):
        self.need, self.ms, self.open, self.count = need, ms, deque(), 0

    def _settle(self, now: float | None) -> None:
        while self.open and (now is None or now - self.open[0] >= self.ms):
            inside = [t for t in self.open if t - self.open[0] < self.ms]
            if len(inside) >= self.need:
                self.count += 1
                for _ in inside:
                    self.open.popleft()
            else:
                self.open.popleft()

    def add(self, at: float) -> None:
        self._settle(at)
        self.open.append(at)

    def done(self) -> int:
        self._settle(None)
        return self.count


class Rage:
    """Bursts of clicks on one spot within RAGE_MS of the first; the clicks of a counted burst are used up."""

    def __init__(self):
        self.open, self.count = deque(), 0

    def _settle(self, now: float | None) -> None:
        while self.open and (now is None or now - self.open[0][0] > RAGE_MS):
            first = self.open.popleft()
            if first[4]:
                continue
            spot = [c for c in self.open if not c[4] and c[0] - first[0] <= RAGE_MS and ((c[1] is not None and c[1] == first[1]) or math.hypot(c[2] - first[2], c[3] - first[3]) <= RAGE_RADIUS)]
            if len(spot) + 1 >= RAGE_CLICKS:
                self.count += 1
                for c in spot:
                    c[4] = True

    def add(self, at: float, target, x: float, y: float) -> None:
        self._settle(at)
        self.open.append([at, target, x, y, False])

    def done(self) -> int:
        self._settle(None)
        return self.count


class Session:
    """All signals of one session."""

    def __init__(self):
        self.n = dict.fromkeys(WEIGHTS, 0)
        self.bursts = {s: Burst(need, ms) for s, (_, need, ms) in BURSTS.items()}
        self.by_kind = {kind: s for s, (kind, _, _) in BURSTS.items()}
        self.rage, self.scroll, self.last, self.forms = Rage(), Burst(*SCROLL), 0, {}

    def add(self, kind, at, target, x, y, dead, delta) -> None:
        if kind == "click":
            self.n["dead_click"] += bool(dead)
            self.rage.add(at, target, x, y)
        elif kind == "reload":
            self.n["reload"] += 1
        elif kind in self.by_kind:
            self.bursts[self.by_kind[kind]].add(at)
        elif kind == "scroll" and delta:
            sign = 1 if delta > 0 else -1
            if self.last and sign != self.last:
                self.scroll.add(at)
            self.last = sign
        elif kind == "form_error":
            self.forms[target or ""] = self.forms.get(target or "", 0) + 1

    def done(self) -> dict[str, int]:
        out = dict(self.n)
        out["rage_click"] = self.rage.done()
        out["scroll_thrash"] = self.scroll.done()
        out["form_error_repeat"] = sum(c >= FORM_ERRORS for c in self.forms.values())
        return out | {s: b.done() for s, b in self.bursts.items()}


def _val(v, default):
    return default if v is None or (isinstance(v, float) and math.isnan(v)) else v


def frustration_signals(events: DataFrame) -> DataFrame:
    """(session, one count per signal) of events (session, kind, at_ms, target, x, y, dead, delta, seq)."""
    names = list(WEIGHTS)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, s, out = None, None, []
        for pdf in batches:
            for r in pdf.itertuples(index=False):
                if s is None or r.session != now:
                    if s is not None:
                        out.append((now, *[s.done()[k] for k in names]))
                    now, s = r.session, Session()
                s.add(r.kind, r.at_ms, _val(r.target, None), float(_val(r.x, 0.0)), float(_val(r.y, 0.0)), _val(r.dead, False), _val(r.delta, 0.0))
            yield pd.DataFrame(out, columns=["session", *names])
            out = []
        if s is not None:
            yield pd.DataFrame([(now, *[s.done()[k] for k in names])], columns=["session", *names])

    ordered = events.filter("session IS NOT NULL AND at_ms IS NOT NULL").repartition("session").sortWithinPartitions("session", "at_ms", "seq")
    return ordered.mapInPandas(run, "session string, " + ", ".join(f"{k} int" for k in names))


RING = 200


def latest(events: DataFrame, ring: int = RING) -> DataFrame:
    """The last events of each session, as a client's tracker holds them; salted first, so a hot session is never one task's sort."""
    from pyspark.sql import Window as W

    order = [F.desc("at_ms"), F.desc("seq")]
    some = events.withColumn("salt_", F.pmod(F.xxhash64("at_ms", "seq"), F.lit(32)))
    some = some.withColumn("r_", F.row_number().over(W.partitionBy("session", "salt_").orderBy(*order))).filter(F.col("r_") <= ring)
    return some.withColumn("r_", F.row_number().over(W.partitionBy("session").orderBy(*order))).filter(F.col("r_") <= ring).drop("salt_", "r_")


def frustration_score() -> Column:
    """1 − exp(−Σ weight × count), to four decimals."""
    total = sum((F.greatest(F.col(k), F.lit(0)) * w for k, w in WEIGHTS.items()), F.lit(0.0))
    return F.round(1 - F.exp(-total), 4)


def greedy_bursts(events: DataFrame, need: int, ms: int) -> DataFrame:
    """(key, bursts) of events (key, at_ms)."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, b = None, None
        for pdf in batches:
            out = []
            for k, at in zip(pdf["key"], pdf["at_ms"]):
                if b is None or k != now:
                    if b is not None:
                        out.append((now, b.done()))
                    now, b = k, Burst(need, ms)
                b.add(at)
            yield pd.DataFrame(out, columns=["key", "bursts"])
        if b is not None:
            yield pd.DataFrame([(now, b.done())], columns=["key", "bursts"])

    return events.filter("key IS NOT NULL AND at_ms IS NOT NULL").repartition("key").sortWithinPartitions("key", "at_ms").mapInPandas(run, "key string, bursts int")


def rate_limit(requests: DataFrame, limit: int, window_ms: int) -> DataFrame:
    """(key, at_ms, seq, allowed, remaining, retry_after_ms): at most limit admitted requests in (now − window, now]; refused ones do not count."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, hits = None, deque()
        for pdf in batches:
            out = []
            for k, at, seq in zip(pdf["key"], pdf["at_ms"], pdf["seq"]):
                if k != now:
                    now, hits = k, deque()
                while hits and hits[0] <= at - window_ms:
                    hits.popleft()
                if len(hits) >= limit:
                    out.append((k, at, seq, False, 0, max(1, math.ceil(hits[0] + window_ms - at))))
                else:
                    hits.append(at)
                    out.append((k, at, seq, True, limit - len(hits), 0))
            yield pd.DataFrame(out, columns=["key", "at_ms", "seq", "allowed", "remaining", "retry_after_ms"])

    ordered = requests.filter("key IS NOT NULL AND at_ms IS NOT NULL").repartition("key").sortWithinPartitions("key", "at_ms", "seq")
    return ordered.mapInPandas(run, "key string, at_ms bigint, seq bigint, allowed boolean, remaining int, retry_after_ms bigint")


def reversals(events: DataFrame) -> DataFrame:
    """(session, at_ms) of scroll events whose direction differs from the one before."""
    from pyspark.sql import Window as W

    s = events.filter("kind = 'scroll' AND delta <> 0").withColumn("sign", F.signum("delta"))
    before = F.lag("sign").over(W.partitionBy("session").orderBy("at_ms", "seq"))
    return s.withColumn("before", before).filter("before <> sign").select("session", "at_ms")
