"""Functions that need a program for each row: Arrow-batched, never row-at-a-time Python UDFs."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftmill.scratch import kept

_BLOCK = re.compile(r"^---\n(.*?)\n---\n?(.*)\Z", re.S)
_KEY_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789_.-")


def unquoted(value: str) -> str:
    """Text between the first quotation mark and the next of its kind (or the end)."""
    mark, rest = value[0], value[1:]
    return rest.split(mark, 1)[0].replace("\\" + mark, mark)


def typed(value: str):
    """A front-matter value: an inline list, quoted text, an integer, or plain text."""
    value = value.strip()
    match value[:1], value[-1:]:
        case "[", "]":
            return [typed(part) for part in value[1:-1].split(",")] if value[1:-1].strip() else []
        case ("'" | '"'), _:
            return unquoted(value)
    digits = value.removeprefix("-")
    return int(value) if digits.isdecimal() and digits.isascii() else value


def board_frontmatter(text: str | None) -> tuple[dict, str]:
    """The front matter of a board file and its body. A key without a value opens a list of the ``- item`` lines below."""
    text = (text or "").replace("\r\n", "\n")
    block = _BLOCK.match(text)
    if block is None:
        return {}, text
    fields: dict = {}
    open_list: list | None = None
    for line in block[1].split("\n"):
        dash, _, item = line.lstrip().partition(" ")
        if dash == "-" and item and open_list is not None:
            open_list.append(typed(item))
            continue
        key, colon, value = line.partition(":")
        if colon and key and _KEY_CHARS.issuperset(key):
            fields[key] = typed(value) if value.strip() else []
            open_list = fields[key] if isinstance(fields[key], list) else None
    return fields, block[2]


@F.pandas_udf(T.StructType().add("frontmatter", "string").add("body", "string"))
def parse_board(texts: pd.Series) -> pd.DataFrame:
    rows = [board_frontmatter(t) for t in texts]
    return pd.DataFrame({"frontmatter": [json.dumps(m, ensure_ascii=False) for m, _ in rows], "body": [b for _, b in rows]})


def render_board(fields: dict, body: str) -> str:
    """A board file; lists are written inline."""
    show = lambda v: "[" + ", ".join(map(str, v)) + "]" if isinstance(v, list) else str(v)
    return "---\n" + "\n".join(f"{k}: {show(v)}" for k, v in fields.items()) + "\n---\n" + body


def patched_frontmatter(text: str, changes: dict[str, str], today: str) -> str:
    """Keys updated in place or added at the end, ``updated`` set, the body kept."""
    m = _BLOCK.match(text)
    lines, body = (m[1].split("\n"), m[2]) if m else ([], text)
    changes = {**changes, "updated": today}
    out, seen = [], set()
    for line in lines:
        key = line.partition(":")[0].strip()
        if key in changes:
            line = f"{key}: {changes[key]}"
            seen.add(key)
        out.append(line)
    out += [f"{k}: {v}" for k, v in changes.items() if k not in seen]
    return "---\n" + "\n".join(out) + "\n---\n" + body


def line_diff(before: str, after: str, context: int = 3, most_cells: int = 2_000_000) -> dict:
    """Added and removed lines, unified hunks, and whether a heading changed.

    Equal lines at both ends are set aside first; if the middle is too large to compare, it counts as one replacement.
    """
    a, b = before.replace("\r\n", "\n").split("\n"), after.replace("\r\n", "\n").split("\n")
    lead = 0
    while lead < min(len(a), len(b)) and a[lead] == b[lead]:
        lead += 1
    tail = 0
    while tail < min(len(a), len(b)) - lead and a[-1 - tail] == b[-1 - tail]:
        tail += 1
    x, y = a[lead : len(a) - tail], b[lead : len(b) - tail]
    if len(x) * len(y) > most_cells:
        ops = [("-", s) for s in x] + [("+", s) for s in y]
    else:
        longest = [[0] * (len(y) + 1) for _ in range(len(x) + 1)]
        for i in reversed(range(len(x))):
            for j in reversed(range(len(y))):
                longest[i][j] = longest[i + 1][j + 1] + 1 if x[i] == y[j] else max(longest[i + 1][j], longest[i][j + 1])
        ops, i, j = [], 0, 0
        while i < len(x) or j < len(y):
            if i < len(x) and j < len(y) and x[i] == y[j]:
                ops.append((" ", x[i]))
                i, j = i + 1, j + 1
            elif j == len(y) or i < len(x) and longest[i + 1][j] >= longest[i][j + 1]:
                ops.append(("-", x[i]))
                i += 1
            else:
                ops.append(("+", y[j]))
                j += 1
    ops = [(" ", s) for s in a[max(0, lead - context) : lead]] + ops + [(" ", s) for s in a[len(a) - tail : len(a) - tail + context]]
    changed = [(k, s) for k, s in ops if k != " "]
    return {
        "added": sum(k == "+" for k, _ in changed), "removed": sum(k == "-" for k, _ in changed), "unified": "\n".join(k + s for k, s in ops) if changed else "",
        "structural": any(re.match(r"#{1,6}\s", s) for _, s in changed),
    }


@F.pandas_udf(T.StructType().add("added", "integer").add("removed", "integer").add("unified", "string").add("structural", "boolean"))
def diff(before: pd.Series, after: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([line_diff(a or "", b or "") for a, b in zip(before, after, strict=True)], columns=["added", "removed", "unified", "structural"])


def expanded(query: str, mappings: list[tuple[str, list[str]]]) -> str:
    """A query with mapped terms replaced: spaces, hyphens and case don't matter, ASCII word borders do.

    Mappings apply in turn, so a later one sees what an earlier one wrote; several canonicals become ``(A OR B)``.
    """
    for term, names in mappings:
        letters = [re.escape(c) for c in re.sub(r"[\s-]+", "", term)]
        if not letters or not names:
            continue
        pattern = r"(?<![A-Za-z0-9_])" + r"[ \t\n\r-]*".join(letters) + r"(?![A-Za-z0-9_])"
        by = names[0] if len(names) == 1 else f"({' OR '.join(names)})"
        query = re.sub(pattern, lambda _, by=by: by, query, flags=re.I)
    return query


def expand_terms(queries: DataFrame, mappings: DataFrame, column: str = "query", most_mappings: int = 100_000) -> DataFrame:
    """``queries`` with an ``expanded`` column; mappings (term, canonicals) apply in order of term.

    The list is curated and small; it is counted, and beyond ``most_mappings`` taken in parts, each a pass over the queries
    that starts from what the last one wrote.
    """
    schema = f"{', '.join(f'`{n}` {t}' for n, t in queries.dtypes)}, expanded string"
    key = F.struct("term", "canonicals")
    left, last, source = mappings.count(), None, column
    while True:
        rest = mappings if last is None else mappings.where(key > F.struct(F.lit(last["term"]), F.lit(last["canonicals"]).cast("array<string>")))
        held = [(r["term"], list(r["canonicals"])) for r in rest.orderBy("term", "canonicals").limit(most_mappings).collect()]
        if held and len(held) < left:  # the part ends after all rows equal to its last one
            last = {"term": held[-1][0], "canonicals": held[-1][1]}
            same = mappings.where((F.col("term") == last["term"]) & (F.col("canonicals") == F.lit(last["canonicals"]).cast("array<string>"))).count()
            held += [held[-1]] * (same - held.count(held[-1]))

        def run(batches: Iterator[pd.DataFrame], held=held, source=source) -> Iterator[pd.DataFrame]:
            for batch in batches:
                yield batch.assign(expanded=[expanded(q or "", held) for q in batch[source]])

        queries = queries.mapInPandas(run, schema)
        left -= len(held)
        if not held or left <= 0:
            return queries
        queries, source = kept(queries, "expand"), "expanded"  # so that only one part is held at a time


def append_log(body: Column, line: Column) -> Column:
    """A line added to the log section, which is opened at the end if there is none."""
    return F.when(body.rlike(r"(?m)^## Log$"), F.concat(F.regexp_replace(body, r"\s+$", ""), F.lit("\n- "), line, F.lit("\n"))).otherwise(F.concat(F.regexp_replace(body, r"\s+$", ""), F.lit("\n\n## Log\n\n- "), line, F.lit("\n")))


def insert_progress(body: Column, row: Column) -> Column:
    """A row put right below the header of the progress table, which is made if there is none."""
    head = "## Progress Log\n\n| UTC timestamp | status | progress |\n|---|---|---|\n"
    return F.when(body.contains("|---|---|---|\n"), F.regexp_replace(body, r"(\|---\|---\|---\|\n)", F.concat(F.lit("$1"), row, F.lit("\n")))).otherwise(F.concat(F.regexp_replace(body, r"\s+$", ""), F.lit("\n\n" + head), row, F.lit("\n")))


def strip_progress(body: Column) -> Column:
    """A body without its progress section."""
    return F.regexp_replace(body, r"(?s)\n*##\s+Progress Log\n.*?(?=\n##\s|\z)", "")
