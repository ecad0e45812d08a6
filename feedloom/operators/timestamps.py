"""Timestamps in mixed notations, precisions and zones, normalised to epoch milliseconds UTC.

A value is reduced to its shape mask: digits become 9, letters a, everything else stays. A mask fixes where every field
stands, so it is mapped to a parser once (per worker; the map is cached), and all values of a batch with that mask are
converted together as columns of character codes. Local times go through tables of zone transitions whose tz database
version is reported by ``zone_version()``; a local time that was skipped or occurred twice names no instant.

Defined results: null, empty, unusable or impossible values give null; surrounding white space is ignored; digits finer
than a millisecond are cut off. A zone written in the value wins over the default zone; where an offset and a bracketed
zone are both given, the offset counts. An unknown zone or a missing default zone gives null, and so does a value of more
than 64 characters: no notation is that long.
"""

from __future__ import annotations

import re
from datetime import datetime
from functools import lru_cache
from zoneinfo import ZoneInfo

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Month names and their usual short forms.
MONTHS = {
    "en": "january february march april may june july august september october november december",
    "de": "januar februar märz april mai juni juli august september oktober november dezember",
    "fr": "janvier février mars avril mai juin juillet août septembre octobre novembre décembre",
    "es": "enero febrero marzo abril mayo junio julio agosto septiembre octubre noviembre diciembre",
}
SHORT_MONTHS = {
    "en": "jan feb mar apr may jun jul aug sep oct nov dec",
    "de": "jan feb mär apr mai jun jul aug sep okt nov dez",
    "fr": "janv févr mars avr mai juin juil août sept oct nov déc",
    "es": "ene feb mar abr may jun jul ago sep oct nov dic",
}
EXTRA_MONTHS = {"en": {"sept": 9}, "de": {"jän": 1, "jänner": 1, "mrz": 3, "maerz": 3, "sept": 9}, "fr": {"fevrier": 2, "fév": 2, "fev": 2, "aout": 8, "decembre": 12, "dec": 12}, "es": {"sept": 9, "set": 9, "setiembre": 9}}

# Zone abbreviations with one meaning in common use, in minutes from UTC.
ABBREVIATIONS = {
    "UTC": 0, "GMT": 0, "Z": 0, "UT": 0, "WET": 0, "WEST": 60, "CET": 60, "CEST": 120, "MEZ": 60, "MESZ": 120, "EET": 120, "EEST": 180, "MSK": 180,
    "EST": -300, "EDT": -240, "CDT": -300, "MST": -420, "MDT": -360, "PST": -480, "PDT": -420, "AKST": -540, "AKDT": -480, "HST": -600, "BRT": -180, "ART": -180,
    "JST": 540, "KST": 540, "SGT": 480, "HKT": 480, "AWST": 480, "ACST": 570, "ACDT": 630, "AEST": 600, "AEDT": 660, "NZST": 720, "NZDT": 780,
}
#: Abbreviations with several meanings: they count only where the record's own zone gives them one.
AMBIGUOUS = ("BST", "IST", "CST")


@lru_cache(maxsize=4096)
def own_meaning(name: str, zone: str | None) -> int | None:
    """Minutes from UTC of an ambiguous abbreviation in a zone that uses it itself; all America writes CST for its central time."""
    try:
        tz = ZoneInfo(zone or "")
    except (KeyError, ValueError, OSError):
        return None
    for month in range(1, 13):
        at = datetime(2020, month, 1, tzinfo=tz)
        if at.tzname() == name:
            return int(at.utcoffset().total_seconds() // 60)
    return -360 if name == "CST" and zone.startswith("America/") else None


EPOCH_FIRST, EPOCH_LAST = -2_208_988_800, 4_102_444_800  # 1900 to 2100


def zone_version() -> str:
    """Version of the tz database the transition tables are built from."""
    try:
        import tzdata

        return tzdata.IANA_VERSION
    except ImportError:
        return "system"


@lru_cache(maxsize=1024)
def transitions(zone: str) -> tuple[np.ndarray, np.ndarray] | None:
    """(instants, offsets): offsets[k] seconds hold from instants[k-1] until instants[k]. None for an unknown zone."""
    from datetime import UTC, datetime

    try:
        tz = ZoneInfo(zone)
    except Exception:
        return None
    off = lambda t: int(datetime.fromtimestamp(t, UTC).astimezone(tz).utcoffset().total_seconds())
    at, offsets, step = [], [off(EPOCH_FIRST)], 86_400 * 7
    t = EPOCH_FIRST
    while t < EPOCH_LAST:
        if off(t + step) != offsets[-1] or off(t + step // 2) != offsets[-1]:
            for lo in (t, t + step // 2):
                hi = lo + step // 2
                a, b = lo, hi
                if off(b) != offsets[-1]:
                    while b - a > 1:
                        mid = (a + b) // 2
                        a, b = (mid, b) if off(mid) == offsets[-1] else (a, mid)
                    at.append(b)
                    offsets.append(off(b))
        t += step
    return np.array(at, dtype=np.int64), np.array(offsets, dtype=np.int64)


def local_to_utc(local: np.ndarray, zone: str | None) -> tuple[np.ndarray, np.ndarray]:
    """UTC seconds of wall-clock seconds, and whether exactly one instant shows that wall-clock time."""
    table = transitions(zone) if zone else None
    if table is None:
        return local, np.zeros(len(local), bool)
    at, off = table
    first = np.searchsorted(at, local - 86_400 * 2, side="right")
    n, found = np.zeros(len(local), int), np.zeros(len(local), np.int64)
    for k in range(4):
        seg = np.minimum(first + k, len(at))
        utc = local - off[seg]
        ok = (first + k <= len(at)) & ((seg == 0) | (utc >= at[np.maximum(seg - 1, 0)] if len(at) else True)) & ((seg == len(at)) | (utc < at[np.minimum(seg, len(at) - 1)] if len(at) else True))
        found = np.where(ok, utc, found)
        n += ok
    return found, n == 1


@lru_cache(maxsize=64)
def _months(lang: str) -> dict[str, int]:
    out: dict[str, int] = {}
    for code in dict.fromkeys(["en", lang]):
        for names in (SHORT_MONTHS, MONTHS):
            for i, name in enumerate(names.get(code, "").split()):
                out[name] = i + 1
        out |= EXTRA_MONTHS.get(code, {})
    return out


_TIME = r"(?P<h>99?):(?P<mi>99)(?::(?P<s>99)(?:[.,](?P<f>9{1,12}))?)?(?: ?(?P<ap>aa)(?!a))?"
_ZONE = r"(?: ?(?P<z1>a)| ?(?P<off>[+-]99(?::?99)?)(?:\[(?P<br>[a_/+9-]+)\])?| (?P<zn>a{2,5})(?:(?P<zo>[+-]99?(?::?99)?))?| ?\[(?P<br2>[a_/+9-]+)\])?"
_SHAPES = [
    re.compile(rf"(?P<y>9999)(?P<ds>[-/.])(?P<m>99?)(?P=ds)(?P<d>99?)(?:(?P<t>a)|,? +){_TIME}{_ZONE}"),
    re.compile(rf"(?P<y>9999)(?P<m>99)(?P<d>99)(?:(?P<t>a)| )(?P<h>99)(?P<mi>99)(?:(?P<s>99)(?:[.,](?P<f>9{{1,12}}))?)?(?P<ap>)?{_ZONE}"),
    re.compile(rf"(?P<p1>99?)(?P<ds>[/.])(?P<p2>99?)(?P=ds)(?P<y>9999),? +{_TIME}{_ZONE}"),
    re.compile(rf"(?:(?P<dow>a{{2,12}})\.?,? )?(?P<d>99?)\.?(?: aa)? (?P<mon>a{{3,12}})\.?(?: aa)?,? (?P<y>9999),? +{_TIME}{_ZONE}"),
    re.compile(rf"(?:(?P<dow>a{{2,12}})\.?,? )?(?P<mon>a{{3,12}})\.? (?P<d>99?),? (?P<y>9999),? +{_TIME}{_ZONE}"),
    re.compile(r"(?P<epoch>9{10}|9{13})"),
]
_CANONICAL = ("9999-99-99a99:99:99a", "9999-99-99a99:99:99.999a")


class _Mask(dict):
    def __missing__(self, code: int) -> str:
        ch = chr(code)
        out = "9" if "0" <= ch <= "9" else "a" if ch.isalpha() else "\0" if ch.isdigit() else ch
        if len(self) < 70_000:
            self[code] = out
        return out


_mask = _Mask()


def shape_mask(value: str) -> str:
    return value.translate(_mask)


@lru_cache(maxsize=65_536)
def parser_for(mask: str) -> dict[str, slice] | None:
    """Where the fields stand in every value of this mask, or None if the mask names no instant."""
    lead = len(mask) - len(mask.lstrip())
    body = mask.strip()
    if len(body) > 64:
        return None
    for shape in _SHAPES:
        if m := shape.fullmatch(body):
            return {k: slice(*(x + lead for x in m.span(k))) for k, v in m.groupdict().items() if v}
    return None


def _number(codes: np.ndarray, at: slice) -> np.ndarray:
    out = np.zeros(len(codes), np.int64)
    for j in range(at.start, at.stop):
        out = out * 10 + (codes[:, j].astype(np.int64) - 48)
    return out


def _words(values: np.ndarray, at: slice) -> list[str]:
    return [v[at] for v in values]


def _offset(text: str) -> int | None:
    """Seconds of +HH, +HHMM or +HH:MM; None beyond the offsets in use."""
    digits = text[1:].replace(":", "")
    h, m = (int(digits), 0) if len(digits) <= 2 else (int(digits[:-2]), int(digits[-2:]))
    return None if h > 14 or m > 59 else (-1 if text[0] == "-" else 1) * (h * 3600 + m * 60)


def _days(y: np.ndarray, m: np.ndarray, d: np.ndarray) -> np.ndarray:
    """Days since 1970 of a proleptic Gregorian date."""
    y = y - (m <= 2)
    era = y // 400
    yoe = y - era * 400
    doy = (153 * (m + np.where(m > 2, -3, 9)) + 2) // 5 + d - 1
    return era * 146_097 + yoe * 365 + yoe // 4 - yoe // 100 + doy - 719_468


def _convert(values: np.ndarray, at: dict[str, slice], zones: np.ndarray, locales: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    n = len(values)
    width = len(values[0])
    codes = np.array(values, dtype=f"U{width}").view(np.uint32).reshape(n, width)
    if "epoch" in at:
        v = _number(codes, at["epoch"])
        return (v if at["epoch"].stop - at["epoch"].start == 13 else v * 1000), np.ones(n, bool)
    ok = np.ones(n, bool)
    y = _number(codes, at["y"])
    if "p1" in at:
        a, b = _number(codes, at["p1"]), _number(codes, at["p2"])
        us = np.array([x == "en-US" for x in locales]) & (codes[:, at["ds"].start] == ord("/"))
        m, d = np.where(us, a, b), np.where(us, b, a)
    elif "mon" in at:
        d = _number(codes, at["d"])
        m = np.array([_months((loc or "en")[:2]).get(w.lower(), 0) for w, loc in zip(_words(values, at["mon"]), locales)], np.int64)
    else:
        m, d = _number(codes, at["m"]), _number(codes, at["d"])
    if "t" in at:
        ok &= np.isin(codes[:, at["t"].start], (ord("T"), ord("t")))
    h, mi = _number(codes, at["h"]), _number(codes, at["mi"])
    s = _number(codes, at["s"]) if "s" in at else np.zeros(n, np.int64)
    if "ap" in at:
        ap = np.array([x.upper() for x in _words(values, at["ap"])])
        ok &= np.isin(ap, ("AM", "PM")) & (h >= 1) & (h <= 12)
        h = h % 12 + 12 * (ap == "PM")
    ms = np.zeros(n, np.int64)
    if "f" in at:
        f = at["f"]
        ms = _number(codes, slice(f.start, min(f.stop, f.start + 3))) * 10 ** max(0, 3 - (f.stop - f.start))
    leap = (y % 4 == 0) & ((y % 100 != 0) | (y % 400 == 0))
    length = np.array([0, 31, 28, 31, 30, 31, 30, 31, 31, 30, 31, 30, 31])[np.clip(m, 0, 12)] + ((m == 2) & leap)
    ok &= (y >= 1) & (m >= 1) & (m <= 12) & (d >= 1) & (d <= length) & (h <= 23) & (mi <= 59) & (s <= 59)
    local = _days(y, np.clip(m, 1, 12), d) * 86_400 + h * 3600 + mi * 60 + s
    if "z1" in at:
        return local * 1000 + ms, ok & np.isin(codes[:, at["z1"].start], (ord("Z"), ord("z")))
    if "off" in at or "zn" in at:
        cache: dict[tuple, int | None] = {}
        shift = np.zeros(n, np.int64)
        names = _words(values, at["zn"]) if "zn" in at else [""] * n
        texts = _words(values, at["off"] if "off" in at else at["zo"]) if "off" in at or "zo" in at else [""] * n
        for i in range(n):
            key = (names[i], texts[i], zones[i] if names[i].upper() in AMBIGUOUS else None)
            if key not in cache:
                base = 0
                if key[0]:
                    name = key[0].upper()
                    minutes = own_meaning(name, key[2] if isinstance(key[2], str) else None) if name in AMBIGUOUS else ABBREVIATIONS.get(name)
                    base = None if minutes is None or (key[1] and name not in ("GMT", "UTC", "UT")) else minutes * 60
                extra = _offset(key[1]) if key[1] else 0
                cache[key] = None if base is None or extra is None else base + extra
            got = cache[key]
            ok[i] &= got is not None
            shift[i] = got or 0
        return (local - shift) * 1000 + ms, ok
    named = np.array(_words(values, at["br2"]), dtype=object) if "br2" in at else zones
    utc = np.zeros(n, np.int64)
    code, uniques = pd.factorize(np.array([z if z is not None else "" for z in named], dtype=object))
    for k, zone in enumerate(uniques):
        rows = code == k
        utc[rows], one = local_to_utc(local[rows], zone or None)
        ok[rows] &= one
    return utc * 1000 + ms, ok


def normalise(values: pd.Series, zones: pd.Series, locales: pd.Series) -> pd.DataFrame:
    """Per value: utc_ms (null if it names no instant) and canonical (already written as YYYY-MM-DDThh:mm:ss[.fff]Z)."""
    raw = values.to_numpy(object)
    n = len(raw)
    masks = np.array([shape_mask(v) if isinstance(v, str) else "" for v in raw], dtype=object)
    code, uniques = pd.factorize(masks)
    z = np.where(pd.isna(zones), None, zones.to_numpy(object))
    loc = np.where(pd.isna(locales), None, locales.to_numpy(object))
    ms, good, canonical = np.zeros(n, np.int64), np.zeros(n, bool), np.zeros(n, bool)
    order = np.argsort(code, kind="stable")
    bounds = np.searchsorted(code[order], np.arange(len(uniques) + 1))
    for k, mask in enumerate(uniques):
        at = parser_for(mask)
        if not at:
            continue
        rows = order[bounds[k]:bounds[k + 1]]
        ms[rows], good[rows] = _convert(raw[rows], at, z[rows], loc[rows])
        if mask in _CANONICAL:
            canonical[rows] = [v[10] == "T" and v[-1] == "Z" for v in raw[rows]]
    return pd.DataFrame({"utc_ms": pd.Series(ms, dtype="Int64").mask(~good), "canonical": canonical})


_RESULT = T.StructType([T.StructField("utc_ms", T.LongType()), T.StructField("canonical", T.BooleanType())])


@F.pandas_udf(_RESULT)
def _normalise_udf(values: pd.Series, zones: pd.Series, locales: pd.Series) -> pd.DataFrame:
    return normalise(values, zones, locales)


def to_utc(value: Column, zone: Column, locale: Column) -> Column:
    """struct(utc_ms, canonical) of a written timestamp, its default zone and its writer's locale."""
    return _normalise_udf(value.cast("string"), zone.cast("string"), locale.cast("string"))
