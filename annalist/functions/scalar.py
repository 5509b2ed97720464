"""Scalar functions of the pipeline as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from annalist.functions.lexing import LANGUAGES

SUPPORTED = r"\.(py|js|ts|go|java|cpp|cc|cxx|h|hpp)$"


def supported_path(path: str) -> Column:
    """FLT1: paths with a supported extension, case as written."""
    return F.col(path).rlike(SUPPORTED)


def language(path: str) -> Column:
    """Language of a path by its extension in any case, else null."""
    ext = F.lower(F.regexp_extract(F.col(path), r"(\.[^./]*)$", 1))
    return F.create_map(*[F.lit(x) for kv in LANGUAGES.items() for x in kv])[ext]


def simple_name(name: Column) -> Column:
    """The text after the last `::`, then after the last dot."""
    return F.substring_index(F.substring_index(name, "::", -1), ".", -1)


def owner(full_name: Column) -> Column:
    return F.substring_index(full_name, "/", 1)


def first_line(text: Column) -> Column:
    return F.substring_index(text, "\n", 1)


def truthy(text: Column, default: str) -> Column:
    """Null and empty fall back, as Python's `or` has it."""
    return F.coalesce(F.nullif(text, F.lit("")), F.lit(default))


def iso(ts: str) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")


def branch_of(ref: Column) -> Column:
    """Every occurrence of `refs/heads/` goes, not only a prefix."""
    return F.replace(ref, F.lit("refs/heads/"), F.lit(""))


def repaired_json(reply: Column, schema: str) -> Column:
    """A JSON reply as it is, or the slice from its first brace to its last one; null if neither parses."""
    opts = {"mode": "PERMISSIVE"}
    whole = F.when(F.trim(reply).startswith("{") & F.trim(reply).endswith("}"), F.from_json(reply, schema, opts))
    part = F.from_json(F.nullif(F.regexp_extract(reply, r"(?s)\{.*\}", 0), F.lit("")), schema, opts)
    return F.coalesce(whole, part)


def backoff(attempt: Column, base: float = 0.5) -> Column:
    return F.pow(F.lit(2.0), attempt) * F.lit(base)


def lane_x(col: Column) -> Column:
    return F.lit(18) + F.lit(22) * col


def row_y(row: Column) -> Column:
    return F.lit(44) * row + F.lit(22)


def graph_width(max_col: Column) -> Column:
    return F.greatest(F.lit(36) + F.lit(22) * max_col, F.lit(56))
