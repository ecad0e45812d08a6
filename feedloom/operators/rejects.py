"""Delimited records loaded into typed columns, with the rejected ones and their reason beside them.

Workers write the records of a file (or of a slice of a large one: the header is known, so a file is never one task's
burden) to scratch CSV files, those of one delimiter and width together, and read them with DuckDB. Its reject tables hold the line-level errors, which
are joined back to the raw records by line or file; the accepted rows carry their record number as a last field and come
out typed. A record that a broken neighbour swallowed is read again among well quoted ones. DuckDB is too lenient in two
places (a quote inside an unquoted field, blanks after a closing quote), so records that hold a quote or a bare line
break, and only those, are also held against the grammar of RFC 4180.

Reasons, the first that holds: ``broken_quoting``, ``wrong_column_count``, ``invalid_value``. A record whose file has no
header, no known delimiter or no column for a needed field has the reason ``no_header``. Header and blank rows are no
records. Null text is a blank row.
"""

from __future__ import annotations

import os
import re
import shutil
import tempfile
from bisect import bisect_right
from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedloom.runtime import shared_dir

# Header names by field, in order of preference.
ALIASES = {
    "body": ["body", "description", "text", "comment", "message", "feedback", "subject"],
    "client_ts": ["clientts", "client_ts", "created_at", "created", "date", "timestamp", "submitted_at"],
    "id": ["id", "ticket_id", "external_id"],
    "external_id": ["user_id", "customer_id", "requester_id", "requester", "email", "account_id"],
    "mrr": ["mrr", "revenue", "monthly_revenue", "arr"],
    "kind": ["kind", "type", "category"],
    "route": ["route", "page", "url", "path", "screen"],
    "app_version": ["app_version", "appversion", "version"],
}
FIELDS = list(ALIASES)
#: Records a worker hands to DuckDB at once.
SLICE = 4_000

OUTPUT = "export_id string, rec_no int, reason string, " + ", ".join(f"{f} string" for f in FIELDS) + ", created_at timestamp_ntz, mrr_value double"


@lru_cache(maxsize=64)
def grammar(delim: str) -> tuple[re.Pattern, re.Pattern]:
    """A whole record, and one field with what follows it, by RFC 4180 under this delimiter."""
    d = re.escape(delim)
    field = rf'(?:"(?:[^"]|"")*"|[^"{d}\r\n]*)'
    return re.compile(rf"{field}(?:{d}{field})*"), re.compile(rf'("(?:[^"]|"")*"|[^"{d}\r\n]*)({d}|$)')


def well_quoted(raw: str, delim: str) -> bool:
    """Whether a record (without its line end) is valid by RFC 4180, whatever its number of fields."""
    return bool(grammar(delim)[0].fullmatch(raw))


def split_record(raw: str, delim: str) -> list[str] | None:
    """Fields of a record, or None if its quoting is broken. A carriage return left at the end is no part of it."""
    raw = raw[:-1] if raw.endswith("\r") else raw
    if '"' not in raw:
        return None if "\n" in raw or "\r" in raw else raw.split(delim)
    whole, one = grammar(delim)
    if not whole.fullmatch(raw):
        return None
    out, at = [], 0
    while True:
        m = one.match(raw, at)
        text = m[1]
        out.append(text[1:-1].replace('""', '"') if text.startswith('"') else text)
        at = m.end()
        if not m[2]:
            return out


def bind(header: list[str]) -> dict[str, int]:
    """Field -> position: the first alias present, names trimmed and lower-cased."""
    names = [h.lstrip("﻿").strip().lower() for h in header]
    return {f: names.index(a[0]) for f, aliases in ALIASES.items() if (a := [x for x in aliases if x in names])}


#: What counts as blank around a value.
BLANKS = "".join(chr(c) for c in range(0x3001) if chr(c).isspace())

_TYPED = """
SELECT rec, {fields}, try_strptime(ts, '%Y-%m-%dT%H:%M:%SZ') AS created_at, try_cast(regexp_replace(trim(coalesce("mrr", ''), $blanks), '[$€£,\\s]', '', 'g') AS DOUBLE) AS mrr_value,
  NOT (regexp_full_match(trim("id", $blanks), 'T-[0-9]+') AND trim("body", $blanks) <> '' AND NOT contains("body", chr(65533))
    AND regexp_full_match(ts, '[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}T([01][0-9]|2[0-3]):[0-5][0-9]:[0-5][0-9]Z') AND left(ts, 4) <> '0000' AND created_at IS NOT NULL) AS unusable
FROM (SELECT *, trim("client_ts", $blanks) AS ts FROM (
  SELECT r.rec::INTEGER AS rec, {bound} FROM {read} r JOIN places p ON p.rec = r.rec::INTEGER))"""


class _Loader:
    """Reads CSV files of one delimiter and width with DuckDB: typed rows, and the errors its reject tables hold.

    places: the column of each field by record number (null: the file has none), as files differ in the order of columns.
    """

    def __init__(self, con, folder: str, delim: str, width: int, places: pd.DataFrame):
        self.con, self.folder, self.delim, self.width, self.places = con, folder, delim, width, places

    def write(self, name: str, records: list[tuple[int, str]]) -> str:
        path = os.path.join(self.folder, name)
        lines = [f"{text}{self.delim}{i}\n".encode("utf-8", "surrogatepass") for i, text in records]
        with open(path, "wb") as f:
            f.writelines(lines)
        self.starts = list(accumulate(map(len, lines), initial=0))
        return path

    def read(self, name: str, records: list[tuple[int, str]]) -> tuple[pd.DataFrame | None, list[tuple[int, str]]]:
        """Typed rows by record number, and rejects as (record number, kind): an error's byte position is in the record's line. The file is removed."""
        import duckdb

        path = self.write(name, records)
        quoted = lambda x: "'" + x.replace("'", "''") + "'"
        columns = ", ".join(f"'c{i}': 'VARCHAR'" for i in range(self.width)) + ", 'rec': 'VARCHAR'"
        read = (
            f"read_csv({quoted(path)}, delim={quoted(self.delim)}, quote='\"', escape='\"', header=false, auto_detect=false, columns={{{columns}}}, "
            "store_rejects=true, strict_mode=true, rejects_limit=0, max_line_size=16777216, parallel=false)"
        )
        every = "[" + ", ".join(f"coalesce(r.c{i}, '')" for i in range(self.width)) + "]"
        sql = _TYPED.format(read=read, fields=", ".join(f'"{f}"' for f in FIELDS), bound=", ".join(f'list_extract({every}, p."{f}") AS "{f}"' for f in FIELDS))
        self.con.register("places", self.places)
        try:
            rows = self.con.execute(sql, {"blanks": BLANKS}).df()
        except duckdb.InvalidInputException:  # badly quoted files can bring its parser into a state it does not know
            self.con.execute("DROP TABLE IF EXISTS reject_errors; DROP TABLE IF EXISTS reject_scans")
            os.remove(path)
            return None, []
        errors = self.con.execute("SELECT DISTINCT line_byte_position, error_type FROM reject_errors").fetchall()
        self.con.execute("DROP TABLE IF EXISTS reject_errors; DROP TABLE IF EXISTS reject_scans")
        os.remove(path)
        return rows, [(records[min(bisect_right(self.starts, at - 1), len(records)) - 1][0], kind) for at, kind in errors]


def _load_slice(loader: _Loader, raws: list[str]) -> pd.DataFrame:
    """One row per record: reason and typed fields.

    Records without a quote or bare line break go into one file, where every error is the record's own. The others are read
    together as they stand. There a broken record may swallow its neighbours and be blamed for their columns, so a quoting
    error counts for a record that is badly quoted indeed, and whatever well quoted record does not come back is read
    again among its like, where nothing is swallowed and every error is the record's own. A badly quoted record that is
    neither returned rightly nor reported has a quoted field that never ends, or is one DuckDB lets pass.
    """
    text = [r[:-1] if r.endswith("\r") else r for r in raws]
    tricky = [(i, t) for i, t in enumerate(text) if '"' in t or "\n" in t or "\r" in t]
    hard = {i for i, _ in tricky}
    plain = [(i, t) for i, t in enumerate(text) if i not in hard]
    reasons: dict[int, str] = {}
    got = []

    def read_clean(name: str, records: list[tuple[int, str]]) -> None:
        rows, errors = loader.read(name, records)
        if rows is None:  # the parser gave up on the file: halves, down to the record it cannot read
            half = len(records) // 2
            if half:
                read_clean(name, records[:half])
                read_clean(name, records[half:])
            else:
                reasons[records[0][0]] = "broken_quoting"
            return
        got.append(rows)
        reasons.update((i, "wrong_column_count") for i, _ in errors)

    if plain:
        read_clean("plain.csv", plain)
    if tricky:
        broken = {i for i, t in tricky if not well_quoted(t, loader.delim)}
        rows, errors = loader.read("quoted.csv", tricky)
        reported = {i for i, kind in errors if kind == "UNQUOTED VALUE"}
        silent = broken - reported  # a field that never ends, or one let pass
        reasons |= dict.fromkeys(reported & broken, "broken_quoting") | dict.fromkeys(silent, "broken_quoting")
        back: set[int] = set()
        if rows is not None:
            rows = rows[rows["rec"].isin(hard - broken) & ~rows["rec"].duplicated(keep=False)]
            got.append(rows)
            back = set(rows["rec"])
        again = [(i, t) for i, t in tricky if i not in broken and i not in back]
        if again:
            read_clean("again.csv", again)
    got.append(pd.DataFrame(columns=["rec", *FIELDS, "created_at", "mrr_value", "unusable"]))
    rows = pd.concat([g for g in got if len(g)] or got[-1:], ignore_index=True).set_index("rec").reindex(range(len(text)))
    rows["reason"] = [reasons.get(i) or ("invalid_value" if bad else None) for i, bad in enumerate(rows["unusable"].eq(True))]
    rows.loc[rows["reason"].isin(["broken_quoting", "wrong_column_count"]), [*FIELDS, "created_at", "mrr_value"]] = None
    return rows.reset_index(drop=True)


@lru_cache(maxsize=10_000)
def _layout(head: str | None, delim: str | None) -> tuple[int, tuple[int | None, ...]] | None:
    """Width and the column of each field (from 1) of a file with this header; None if it cannot be loaded."""
    if not (isinstance(delim, str) and len(delim) == 1 and delim not in '"\r\n' and isinstance(head, str)):
        return None
    header = split_record(head.lstrip("\ufeff"), delim)
    at = bind(header) if header else {}
    return (len(header), tuple(at[f] + 1 if f in at else None for f in FIELDS)) if {"id", "body", "client_ts"} <= at.keys() else None


def _scratch(folder: str | None) -> str:
    """A folder of this task's own for the files DuckDB reads, removed with it: in the shared folder where it is mounted."""
    try:
        if folder:
            os.makedirs(folder, exist_ok=True)
        return tempfile.mkdtemp(prefix="rejects-", dir=folder)
    except OSError:  # a shared folder that this worker does not see as files
        return tempfile.mkdtemp(prefix="rejects-")


def _load_batches(shared: str | None):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import duckdb

        con = duckdb.connect(config={"threads": 1, "memory_limit": "400MB"})
        folder = _scratch(shared)
        try:
            for pdf in batches:
                pdf = pdf[[isinstance(r, str) and r.strip() != "" for r in pdf["raw"]]]
                layouts = [_layout(h if isinstance(h, str) else None, d if isinstance(d, str) else None) for h, d in zip(pdf["header"], pdf["delim"])]
                kind = pd.Series([None if x is None else (d, x[0]) for x, d in zip(layouts, pdf["delim"])], index=pdf.index, dtype=object)
                bad = kind.isna()
                if bad.any():
                    yield _finished(pdf[bad], pd.DataFrame({"reason": ["no_header"] * int(bad.sum())}))
                for (delim, width), where in kind[~bad].groupby(kind[~bad]).groups.items():
                    picked = pdf.index.get_indexer(where)
                    for k in range(0, len(picked), SLICE):
                        rows = picked[k:k + SLICE]
                        places = pd.DataFrame([layouts[i][1] for i in rows], columns=FIELDS, dtype="Int32")
                        places.insert(0, "rec", range(len(rows)))
                        part = pdf.iloc[rows]
                        yield _finished(part, _load_slice(_Loader(con, folder, delim, width, places), part["raw"].tolist()))
        finally:
            con.close()
            shutil.rmtree(folder, ignore_errors=True)

    return run


def _finished(part: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
    out = rows.reindex(columns=["reason", *FIELDS, "created_at", "mrr_value"]).astype({f: object for f in ("reason", *FIELDS)})
    out.insert(0, "export_id", part["export_id"].to_numpy())
    out.insert(1, "rec_no", part["rec_no"].to_numpy())
    out["created_at"] = pd.to_datetime(out["created_at"]).astype("datetime64[us]")
    out["mrr_value"] = out["mrr_value"].astype("float64")
    return out.where(out.notna(), None) if out.empty else out


def load_exports(raw: DataFrame, exports: DataFrame) -> DataFrame:
    """(export_id, rec_no, reason, fields…, created_at, mrr_value): one row per record, reason null for the valid ones.

    Headers travel to the records by a join on export_id; a large export stays spread over the tasks that read it (AQE
    turns the join into a broadcast while the headers are few, and splits a skewed one otherwise).
    """
    header = raw.filter(F.col("rec_no") == 0).groupBy("export_id").agg(F.min("raw").alias("header"))
    known = exports.groupBy("export_id").agg(F.min("delim").alias("delim"))
    heads = header.join(known, "export_id", "full_outer")
    records = raw.filter(F.col("rec_no") != 0).select("export_id", "rec_no", "raw")
    where = shared_dir(raw.sparkSession)
    mounted = where.removeprefix("file://") if where.startswith(("file:///", "/")) else None
    return records.join(heads, "export_id", "left").mapInPandas(_load_batches(mounted), OUTPUT)


def valid(loaded: DataFrame) -> DataFrame:
    """The typed tickets: trimmed ids, instants, numbers; empty optional values become null."""
    t = lambda c: F.expr(f"nullif(trim({c}), '')")
    return loaded.filter("reason IS NULL").select(
        "export_id", "rec_no", F.trim("id").alias("ticket_id"), F.col("body").alias("description"), t("external_id").alias("requester_id"),
        F.timestamp_micros(F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', created_at)")).alias("created_at"),
        F.col("mrr_value").alias("mrr"), t("kind").alias("kind"), t("route").alias("route"),
    )


def rejected(loaded: DataFrame) -> DataFrame:
    return loaded.filter("reason IS NOT NULL").select("export_id", "rec_no", "reason")
