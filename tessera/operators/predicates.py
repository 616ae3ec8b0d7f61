"""Typed filters, ordering with explicit nulls, keyset pages, path globs."""

from __future__ import annotations

import base64
import binascii
import json
import re
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: (column, value) -> condition. ``_neq`` keeps nulls, ``_nin`` doesn't; wildcards in ``_contains`` are live.
FILTERS = {
    "_eq": lambda c, v: c.eqNullSafe(F.lit(v)),
    "_neq": lambda c, v: ~c.eqNullSafe(F.lit(v)),
    "_in": lambda c, v: c.isin(*v),
    "_nin": lambda c, v: ~c.isin(*v),
    "_contains": lambda c, v: c.ilike(f"%{v}%"),
    "_like": lambda c, v: c.like(v),
    "_lt": lambda c, v: c < v,
    "_lte": lambda c, v: c <= v,
    "_gt": lambda c, v: c > v,
    "_gte": lambda c, v: c >= v,
    "_is_null": lambda c, v: c.isNull() if v is True else c.isNotNull() if v is False else F.lit(True),
}



def _either(column: Column, values: Sequence[object]) -> Column:
    return reduce(lambda a, v: a | column.eqNullSafe(F.lit(v)), values, F.lit(False))


def _like(pattern: str) -> str:
    """``%`` any run and ``_`` one character, neither across a line's end; all else literally."""
    return r"\A" + "".join({"%": r"[^\n\r\u2028\u2029]*", "_": r"[^\n\r\u2028\u2029]"}.get(c) or re.escape(c) for c in pattern) + r"\z"


#: The filters of catalogue rows, which compare values where ``FILTERS`` compare in SQL: null is a value like any other in
#: ``_in`` and ``_nin``, wildcards in ``_contains`` aren't live, texts are ordered by locale. Only comparisons fail for null.
CATALOGUE = {
    "_eq": lambda c, v: c.eqNullSafe(F.lit(v)),
    "_neq": lambda c, v: ~c.eqNullSafe(F.lit(v)),
    "_in": lambda c, v: _either(c, v),
    "_nin": lambda c, v: ~_either(c, v),
    "_contains": lambda c, v: F.coalesce(F.contains(F.lower(c), F.lit(v.lower())), F.lit(False)),
    "_like": lambda c, v: F.coalesce(c.rlike(_like(v)), F.lit(False)),
    "_lt": lambda c, v: _order(c, v, lambda a, b: a < b),
    "_lte": lambda c, v: _order(c, v, lambda a, b: a <= b),
    "_gt": lambda c, v: _order(c, v, lambda a, b: a > b),
    "_gte": lambda c, v: _order(c, v, lambda a, b: a >= b),
    "_is_null": lambda c, v: c.isNull() if v is True else c.isNotNull(),
}

#: The root locale's order of texts.
LOCALE = "UNICODE"


def _order(column: Column, value: object, holds) -> Column:
    """A comparison that fails for null on either side; by locale unless the value is a number."""
    if value is None:
        return F.lit(False)
    if isinstance(value, str):
        return F.coalesce(holds(F.collate(column.cast("string"), LOCALE), F.collate(F.lit(value), LOCALE)), F.lit(False))
    return F.coalesce(holds(column, F.lit(value)), F.lit(False))


def compile_filter(where: Mapping[str, Mapping[str, object]], filters: Mapping = FILTERS) -> Column:
    """All clauses AND-ed. Unknown operators are refused."""
    clauses = []
    for field, tests in where.items():
        for op, value in tests.items():
            if op not in filters:
                raise ValueError(f"unknown filter {op} on {field}")
            clauses.append(filters[op](F.col(field), value))
    return reduce(lambda a, b: a & b, clauses, F.lit(True))


def where(rows: DataFrame, clauses: Mapping[str, Mapping[str, object]], filters: Mapping = FILTERS) -> DataFrame:
    unknown = set(clauses) - set(rows.columns)
    if unknown:
        raise ValueError(f"unknown fields {sorted(unknown)}")
    return rows.where(compile_filter(clauses, filters))


Order = Sequence[tuple[str, str, str]]  # field, ASC or DESC, FIRST or LAST


def ordering(order: Order, key: str) -> list[Column]:
    kinds = {("ASC", "FIRST"): F.asc_nulls_first, ("ASC", "LAST"): F.asc_nulls_last, ("DESC", "FIRST"): F.desc_nulls_first, ("DESC", "LAST"): F.desc_nulls_last}
    return [kinds[d, n](f) for f, d, n in order] + [F.asc(key)]


def catalogue_ordering(order: Sequence[tuple[str, str]], rows: DataFrame, key: str) -> list[Column]:
    """Nulls last in either direction, texts by locale; then the key."""
    kinds = dict(rows.dtypes)
    by = [(F.collate(F.col(f), LOCALE) if kinds[f] == "string" else F.col(f), d) for f, d in order]
    return [c.asc_nulls_last() if d == "ASC" else c.desc_nulls_last() for c, d in by] + [F.asc(key)]


def encode_cursor(values: Sequence[object], key: object) -> str:
    return base64.urlsafe_b64encode(json.dumps({"o": list(values), "id": key}).encode()).decode().rstrip("=")


def decode_cursor(cursor: str | None, fields: int) -> tuple[list, object] | None:
    """Order values and id; None for no or a malformed cursor."""
    try:
        raw = json.loads(base64.urlsafe_b64decode((cursor or "") + "=" * (-len(cursor or "") % 4)))
        return (raw["o"], raw["id"]) if len(raw["o"]) == fields else None
    except (ValueError, KeyError, TypeError, binascii.Error):
        return None


def after(order: Order, key: str, values: Sequence[object], last: object) -> Column:
    """Rows behind the cursor: a lexicographic chain of null-safe equalities and one strict step."""
    chain, same = F.lit(False), F.lit(True)
    for (field, direction, nulls), v in zip(order, values, strict=True):
        c = F.col(field)
        if v is None:
            step = c.isNotNull() if nulls == "FIRST" else F.lit(False)
        else:
            step = (c > v) if direction == "ASC" else (c < v)
            step = F.coalesce(step, F.lit(False))
            if nulls == "LAST":
                step = step | c.isNull()
        chain = chain | (same & step)
        same = same & c.eqNullSafe(F.lit(v))
    return chain | (same & (F.col(key) > last))


def page(rows: DataFrame, order: Order, key: str, first: int = 50, cursor: str | None = None) -> DataFrame:
    """A keyset page of ``first`` (0..200) rows and one more, from which ``hasNextPage`` is read."""
    at = decode_cursor(cursor, len(order))
    rows = rows.where(after(order, key, *at)) if at else rows
    return rows.orderBy(*ordering(order, key)).limit(max(0, min(first, 200)) + 1)


def glob_regex(pattern: str) -> str:
    """``**`` any path, ``*`` within a segment, ``?`` one character of it; anchored."""
    out, i = "", 0
    while i < len(pattern):
        if pattern.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
        elif pattern.startswith("**", i):
            out, i = out + ".*", i + 2
        else:
            c = pattern[i]
            out, i = out + ("[^/]*" if c == "*" else "[^/]" if c == "?" else re.escape(c)), i + 1
    return f"^{out}$"


def first_match(column: Column, rules: Sequence[tuple[str, str]], default: str) -> Column:
    """The class of the first matching glob, in rule order."""
    out = F.lit(default)
    for pattern, name in reversed(rules):
        out = F.when(column.rlike(glob_regex(pattern)), name).otherwise(out)
    return out


def longest_prefix(rows: DataFrame, column: str, rules: Sequence[tuple[str, str]], fallback: str) -> Column:
    """Exact kind, then the longest prefix, then the fallback: a fixed rule list folds into one expression."""
    out = F.lit(fallback)
    for prefix, name in sorted(rules, key=lambda r: len(r[0])):
        out = F.when(F.startswith(F.col(column), F.lit(prefix)), name).otherwise(out)
    for exact, name in rules:
        out = F.when(F.col(column) == exact, name).otherwise(out)
    return out
