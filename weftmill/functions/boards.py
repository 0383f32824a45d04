"""Board files and front matter written and patched as Column expressions; ``udf.parse_board`` reads them back."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

_SIMPLE = r"^[A-Za-z0-9_./-]+$"


def quoted(value: Column) -> Column:
    """A text bare if it is of letters, digits and ``_./-``, else in double quotes."""
    return F.when(value.rlike(_SIMPLE), value).otherwise(F.concat(F.lit('"'), F.replace(value, F.lit('"'), F.lit('\\"')), F.lit('"')))


def rendered(key: str, value: Column, kind: str) -> Column:
    """The lines of one field, null where the value is: texts quoted if need be, lists as quoted block lists, others as they are."""
    if kind.startswith("array"):
        items = F.array_join(F.transform(value, lambda v: F.concat(F.lit('  - "'), F.coalesce(v.cast("string"), F.lit("")), F.lit('"'))), "\n")
        return F.when(value.isNotNull(), F.when(F.size(value) == 0, f"{key}: []").otherwise(F.concat(F.lit(f"{key}:\n"), items)))
    return F.concat(F.lit(f"{key}: "), quoted(value) if kind == "string" else value.cast("string"))


def board_file(fields: dict[str, tuple[Column, str]], body: Column) -> Column:
    """A whole board file of ``key: (value, type)``; null values are left out, the body ends with a line break."""
    lines = F.array_join(F.array_compact(F.array(*(rendered(k, v, t) for k, (v, t) in fields.items()))), "\n")
    body = F.coalesce(body, F.lit(""))
    return F.concat(F.lit("---\n"), lines, F.lit("\n---\n\n"), F.when(body.endswith("\n"), body).otherwise(F.concat(body, F.lit("\n"))))


def patched(content: Column, changes: dict[str, Column], today: Column) -> Column:
    """Front matter with keys replaced where they stand, or added at its end; ``updated`` is set, the rest and the body stay.

    A null value changes nothing; a text without front matter gets one.
    """
    content = F.replace(F.coalesce(content, F.lit("")), F.lit("\r\n"), F.lit("\n"))
    block = r"(?s)^---\n(.*?)\n---\n?"
    has = content.rlike(r"(?s)^---\n.*?\n---(\n|$)")
    lines = F.when(has, F.split(F.regexp_extract(content, block, 1), "\n")).otherwise(F.array().cast("array<string>"))
    body = F.when(has, F.regexp_replace(content, block, "")).otherwise(content)
    key = lambda line: F.trim(F.substring_index(line, ":", 1))
    every = {**changes, "updated": today}

    def replaced(line: Column) -> Column:
        return reduce(lambda out, kv: F.when((key(line) == kv[0]) & line.contains(":") & kv[1].isNotNull(), F.concat(F.lit(f"{kv[0]}: "), kv[1])).otherwise(out), every.items(), line)

    there = F.transform(F.filter(lines, lambda line: line.contains(":")), key)
    added = [F.when(v.isNotNull() & ~F.array_contains(there, k), F.concat(F.lit(f"{k}: "), v)) for k, v in every.items()]
    return F.concat(F.lit("---\n"), F.array_join(F.concat(F.transform(lines, replaced), F.array_compact(F.array(*added))), "\n"), F.lit("\n---\n"), body)
