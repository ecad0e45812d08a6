"""Exceptions as feedback: frames of a stack, a fingerprint, a text to cluster by."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from feedloom.functions.scalars import day_key, derived_id
from feedloom.functions.text import scrub_variable_data


def frames(stack: Column) -> Column:
    """array<struct<fn, file>> of a V8 stack: positions, folders and queries cut off; runtime and pathless frames left out."""
    lines = F.filter(F.transform(F.split(F.coalesce(stack, F.lit("")), "\n"), lambda x: F.trim(x)), lambda s: s.startswith("at "))
    bodies = F.transform(lines, lambda s: F.trim(F.substring(s, F.lit(4), F.length(s))))
    shape = r"^(.*?)\s+\((.*)\)$"

    def parse(b: Column) -> Column:
        named = b.rlike(shape)
        fn = F.when(named, F.trim(F.regexp_extract(b, shape, 1))).otherwise(F.lit("<anonymous>"))
        where = F.when(named, F.regexp_extract(b, shape, 2)).otherwise(b)
        base = F.regexp_replace(F.regexp_replace(F.regexp_replace(where, r":\d+(:\d+)?$", ""), r"^.*[\\/]", ""), r"\?.*$", "")
        return F.struct(F.when(fn == "", "<anonymous>").otherwise(fn).alias("fn"), base.alias("file"), where.alias("where"))

    parsed = F.filter(F.transform(bodies, parse), lambda f: ~f["where"].startswith("node:") & f["where"].rlike(r"[\\/.]"))
    return F.transform(parsed, lambda f: F.struct(f["fn"].alias("fn"), f["file"].alias("file")))


def fingerprint(name: Column, message: Column, stack: Column, depth: int = 5) -> Column:
    """ex_… of the name and the top frames, or of the scrubbed message where there are none."""
    top = F.slice(frames(stack), 1, depth)
    shown = F.array_join(F.transform(top, lambda f: F.concat(f["fn"], F.lit("@"), f["file"])), "\u0000")
    return F.when(F.size(top) > 0, derived_id(name, shown, prefix="ex_")).otherwise(derived_id(name, scrub_variable_data(message), prefix="ex_"))


def cluster_text(name: Column, message: Column, stack: Column) -> Column:
    top = F.slice(frames(stack), 1, 2)
    head = F.concat(name, F.lit(": "), scrub_variable_data(message))
    return F.when(F.size(top) == 0, head).otherwise(F.concat(head, F.lit(" "), F.array_join(F.transform(top, lambda f: F.concat_ws(" ", f["fn"], f["file"])), " ")))


def fallback_user(fp: Column, client_ts: Column) -> Column:
    """One key per defect and day."""
    return F.concat(F.lit("x:"), fp, F.lit(":"), day_key(client_ts))
