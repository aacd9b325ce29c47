"""Portable query text: ``$n`` parameters and PostgreSQL casts, bound with types for Spark."""

from __future__ import annotations

import datetime as dt
import re
from decimal import Decimal
from typing import Any

_lexeme = re.compile(r"'(?:[^']|'')*'|\"(?:[^\"]|\"\")*\"|--[^\n]*|/\*.*?\*/|\$(\d+)(\s*::\s*[a-z_]+(?:\s*\([^)]*\))?)?|::\s*([a-z_]+)(\s*\([^)]*\))?", re.S | re.I)
#: Unbounded numerics need a scale: Spark would read a bare one as DECIMAL(10,0).
WIDE = "DECIMAL(18,6)"
_types = {"text": "string", "varchar": "string", "char": "string", "bpchar": "string", "integer": "int", "int4": "int", "int8": "bigint", "float8": "double", "double": "double", "real": "float", "bool": "boolean", "timestamptz": "timestamp"}


def spark_type(name: str, size: str = "") -> str:
    name = name.lower()
    if name in ("numeric", "decimal"):
        return f"decimal{size.strip()}" if size.strip() else WIDE
    return _types.get(name, name)


def positions(sql: str) -> list[int]:
    """The distinct parameter numbers in use, in order; those in strings and comments are none."""
    return sorted({int(m[1]) for m in _lexeme.finditer(sql) if m[1]})


def to_spark(sql: str) -> str:
    """``$1::numeric`` becomes ``CAST(:p1 AS DECIMAL(18,6))``; other ``::type`` casts take Spark's names."""

    def turn(m: re.Match) -> str:
        if m[1]:
            if not m[2]:
                return f":p{m[1]}"
            name, _, size = m[2].replace("::", "").strip().partition("(")
            return f"CAST(:p{m[1]} AS {spark_type(name.strip(), '(' + size if size else '')})"
        if m[3]:
            return f"::{spark_type(m[3], m[4] or '')}"
        return m[0]

    return _lexeme.sub(turn, sql).rstrip().rstrip(";")


def bind(types: dict[int, str], values: dict[int, Any], used: list[int]) -> dict[str, Any]:
    """Typed arguments for ``spark.sql``; ValueError for a parameter without a value."""
    missing = [n for n in used if n not in values]
    if missing:
        raise ValueError(f"no value for parameter ${missing[0]}")
    return {f"p{n}": coerce(types.get(n, ""), values[n]) for n in used}


def coerce(kind: str, value: Any) -> Any:
    """A Python value of the declared type; other types leave the value as it is."""
    kind = kind.lower()
    if value is None:
        return None
    if kind in ("numeric", "decimal"):
        return Decimal(str(value))
    if kind == "date":
        return value if isinstance(value, dt.date) else dt.date.fromisoformat(str(value))
    if kind in ("timestamp", "timestamptz"):
        return value if isinstance(value, dt.datetime) else dt.datetime.fromisoformat(str(value))
    if kind in ("bool", "boolean"):
        return value if isinstance(value, bool) else str(value).lower() in ("t", "true", "1")
    if "int" in kind and kind != "interval":
        return int(value)
    if kind in ("double", "float", "real", "float8"):
        return float(value)
    if kind in ("text", "char", "varchar"):
        return str(value)
    return value


def literal(kind: str, value: Any) -> str:
    """The value as SQL that Spark and DuckDB read alike."""
    value = coerce(kind, value)
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return str(value).upper()
    if isinstance(value, dt.datetime):
        return f"TIMESTAMP '{value.isoformat(sep=' ')}'"
    if isinstance(value, dt.date):
        return f"DATE '{value.isoformat()}'"
    if isinstance(value, Decimal):
        return f"CAST({value} AS {WIDE})"
    if isinstance(value, (int, float)):
        return str(value)
    return "'" + str(value).replace("'", "''") + "'"


def inline(sql: str, types: tuple[str, ...], values: tuple) -> str:
    """The query with its parameters as literals."""
    return _lexeme.sub(lambda m: literal(types[int(m[1]) - 1], values[int(m[1]) - 1]) if m[1] else m[0], sql)
