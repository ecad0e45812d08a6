"""Secrets and contact data replaced by typed markers, rule by rule, in the JVM."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rule:
    kind: str
    pattern: str
    luhn: bool = False


# Patterns by kind, the most specific and most damaging first.
RULES = (
    Rule("apikey", r"\b(?:sk|pk|rk)_(?:live|test)_[A-Za-z0-9]{8,}|\bgh[pousr]_[A-Za-z0-9]{16,}|\bxox[baprs]-[A-Za-z0-9-]{10,}|\bAKIA[0-9A-Z]{16}\b|\bsk-ant-[A-Za-z0-9_-]{16,}"),
    Rule("token", r"\b(?:Bearer\s+[A-Za-z0-9._~+/-]+=*|eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]+)"),
    Rule("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"),
    Rule("iban", r"\b[A-Z]{2}\d{2}(?:[ ]?[A-Z0-9]{4}){2,7}(?:[ ]?[A-Z0-9]{1,3})?\b"),
    Rule("ssn", r"\b(?!000|666|9\d\d)\d{3}-(?!00)\d{2}-(?!0000)\d{4}\b"),
    Rule("card", r"(?<![\d-])(?:\d[ -]?){12,18}\d(?![\d-])", luhn=True),
    Rule("phone", r"(?<![\d-])(?:\+\d{1,3}[ -]?)?(?:\(\d{3}\)|\d{3})[ -]\d{3}[ -]\d{4}(?![\d-])"),
)


def marker(kind: str) -> str:
    return f"[redacted:{kind}]"


def _replace(text: Column, rule: Rule) -> Column:
    if not rule.luhn:
        return F.regexp_replace(text, rule.pattern, marker(rule.kind))
    # matches are taken one by one; those whose check digit holds are replaced where they stand
    found = F.regexp_extract_all(text, F.lit(f"({rule.pattern})"), F.lit(1))
    parts = F.split(text, rule.pattern, -1)
    kept = F.transform(found, lambda m: F.when(F.call_function("luhn_check", F.regexp_replace(m, "[ -]", "")), marker(rule.kind)).otherwise(m))
    return F.when(F.size(found) == 0, text).otherwise(F.array_join(F.flatten(F.zip_with(parts, kept, lambda p, k: F.array(p, F.coalesce(k, F.lit(""))))), ""))


def scan(text: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """The text with markers. Every rule sees the output of the one before; markers match no rule, so scanning twice changes nothing."""
    for rule in rules:
        text = _replace(text, rule)
    return text


def counts(scanned: Column, original: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """struct of replacements by kind: markers added by the scan."""
    n = lambda t, k: F.regexp_count(t, F.lit(marker(k).replace("[", r"\[").replace("]", r"\]")))
    return F.struct(*[(n(scanned, r.kind) - n(original, r.kind)).alias(r.kind) for r in rules])
