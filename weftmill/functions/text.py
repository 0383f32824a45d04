"""Text, markdown and topic functions as Column expressions; nothing here leaves the JVM."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Small Latin letters with marks and the letters below them, by Unicode decomposition.
_MARKED = {chr(i): d[0] for i in (*range(0xC0, 0x250), *range(0x1E00, 0x1F00)) if "a" <= (d := unicodedata.normalize("NFD", chr(i)))[0] <= "z" and len(d) > 1}
TOKEN = r"[\p{L}\p{N}]+"
_NOT_WORD_BEFORE, _NOT_WORD_AFTER = r"(?<![A-Za-z0-9_])", r"(?![A-Za-z0-9_])"


def word(pattern: str) -> str:
    """A pattern between ASCII word borders (Java's own border is Unicode-aware)."""
    return f"{_NOT_WORD_BEFORE}(?:{pattern}){_NOT_WORD_AFTER}"


def chain(c: Column, *steps: tuple[str, str]) -> Column:
    """Successive regular-expression replacements."""
    for pattern, by in steps:
        c = F.regexp_replace(c, pattern, by)
    return c


def normalize_markdown(c: Column) -> Column:
    """Markdown as comparable plain text, whatever tool rendered it.

    Blanks are taken possessively, each run once from its start; a single space is left as it is instead of replaced.
    """
    c = chain(
        c,
        (r"^---\r?\n[\s\S]*?\r?\n---\r?\n?", ""), (r"<!--[\s\S]*?-->", " "), (r"!\[[^\]]*\]\([^)]*\)", " "), (r"\[([^\]]*)\]\([^)]*\)", "$1"), (r"```[\s\S]*?```", " "), (r"`([^`]*)`", " $1 "), (r"\*+", ""), (r"_+", ""),
        (r"(?m)^\s*+#{1,6}\s++", ""), (r"(?m)^\s*+>\s?", ""), (r"(?m)^\s*+[-*+]\s++", ""), (r"(?m)^\s*+\d++[.)]\s++", ""), (r"\|", " "), (r"(?<!\s)\s++([.,;:!?])", "$1"), (r" \s++|[\s&&[^ ]]\s*+", " "),
    )
    return F.lower(F.trim(c))


def chunk_hashes(c: Column, words: int = 1000) -> Column:
    """SHA-256 of every ``words`` words of a normalized text."""
    starts = lambda parts: F.sequence(F.lit(1), F.size(parts), F.lit(words))
    hashes = lambda parts: F.transform(starts(parts), lambda s: F.sha2(F.array_join(F.slice(parts, s, F.lit(words)), " "), 256))
    return F.get(F.transform(F.array(F.split(c, " ")), hashes), 0)  # an element: the text is normalized once, not again for each hash


def tokens(c: Column) -> Column:
    return F.regexp_extract_all(F.lower(c), F.lit(TOKEN), F.lit(0))


def slugify(c: Column, most: int = 80) -> Column:
    """A safe stem; ``document`` if nothing is left."""
    s = F.left(chain(F.lower(c), (r"[^a-z0-9]+", "-"), (r"^-+|-+$", "")), F.lit(most))
    return F.when(s == "", "document").otherwise(s)


def document_id(title: Column, source: Column) -> Column:
    """The slug of the source's file stem, else of the title."""
    base = F.element_at(F.split(source, "/"), -1)
    return F.when(F.length(source) > 0, slugify(F.regexp_replace(base, r"(?i)\.(md|markdown|txt)$", ""))).otherwise(slugify(title))


def page_title(c: Column) -> Column:
    """The first level-one heading, or null."""
    t = F.trim(F.regexp_extract(c, r"(?m)^#[ \t]+(.+)$", 1))
    return F.when(t != "", t)


def stem_title(c: Column) -> Column:
    stem = F.regexp_replace(c, r"(?i)\.md$", "")
    words = F.trim(F.regexp_replace(stem, r"[-_]+", " "))
    return F.when(words != "", words).otherwise(stem)


def url_stem(c: Column) -> Column:
    """A stem from a path, or from host, path and the start of the query of a URL."""
    url = c.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://")
    query = F.coalesce(F.left(F.parse_url(c, F.lit("QUERY")), F.lit(32)), F.lit(""))
    whole = F.concat(F.coalesce(F.parse_url(c, F.lit("HOST")), F.lit("")), F.coalesce(F.parse_url(c, F.lit("PATH")), F.lit("")), query)
    path = F.regexp_replace(F.element_at(F.split(c, "/"), -1), r"\.[A-Za-z0-9]+$", "")
    return F.trim(F.regexp_replace(F.when(url, whole).otherwise(path), r"[^A-Za-z0-9._-]+", "_"), F.lit("_"))


def is_topic(c: Column) -> Column:
    return c.rlike(r"^[a-z0-9]+(?:-[a-z0-9]+)*(?:/[a-z0-9]+(?:-[a-z0-9]+)*)*$")


def normalize_topic(c: Column) -> Column:
    """A safe slash path, or null."""
    t = chain(F.lower(F.trim(c)), (r"[^a-z0-9/]+", "-"), (r"-{2,}", "-"), (r"/+", "/"), (r"(^[-/]+)|([-/]+$)", ""), (r"-(?=/)|(?<=/)-", ""))
    return F.when(is_topic(t), t)


def fold_key(c: Column) -> Column:
    """The look-up key of a name (upper case)."""
    return F.upper(c)


def fold_query(c: Column) -> Column:
    """Lower case, trimmed, without diacritics."""
    return F.translate(F.lower(F.trim(c)), "áàâäãåçéèêëíìîïñóòôöõúùûüýÿ", "aaaaaaceeeeiiiinooooouuuuyy")


def fold(c: Column) -> Column:
    """Lower case, trimmed, Latin letters without any of their marks: the form in which names are indexed and asked for."""
    return F.translate(F.lower(F.trim(c)), "".join(_MARKED), "".join(_MARKED.values()))


def unquote(c: Column) -> Column:
    return F.regexp_replace(c, r"^[\"']|[\"']$", "")


def frontmatter(c: Column) -> Column:
    """The leading ``---`` block as a map: split at the first colon, one quote off each end, empty values dropped."""
    block = F.regexp_extract(c, r"^---\r?\n([\s\S]*?)\r?\n---", 1)
    lines = F.filter(F.split(block, r"\r?\n"), lambda x: F.instr(x, ":") > 1)
    pairs = F.transform(lines, lambda x: F.struct(F.trim(F.substring_index(x, ":", 1)).alias("key"), unquote(F.trim(F.regexp_replace(x, r"^[^:]*:", ""))).alias("value")))
    kept = F.filter(pairs, lambda p: (p["key"] != "") & (p["value"] != ""))
    return F.aggregate(kept, F.create_map().cast("map<string,string>"), lambda m, p: F.map_concat(F.map_filter(m, lambda k, v: k != p["key"]), F.create_map(p["key"], p["value"])))


def body(c: Column) -> Column:
    """The text after the leading block."""
    return F.regexp_replace(c, r"^---\r?\n[\s\S]*?\r?\n---\r?\n?", "")


def render_frontmatter(keys: Column, values: Column, rest: Column) -> Column:
    return F.concat(F.lit("---\n"), F.array_join(F.zip_with(keys, values, lambda k, v: F.concat(k, F.lit(": "), v)), "\n"), F.lit("\n---\n"), rest)


def topic_history(c: Column) -> Column:
    """A list written as ``[a, b]`` or ``a, b``."""
    return F.filter(F.transform(F.split(F.regexp_replace(F.coalesce(c, F.lit("")), r"^\[|\]$", ""), ","), lambda x: unquote(F.trim(x))), lambda x: x != "")


def lifecycle(m: Column) -> Column:
    """Read count, confidence and history of a page, with defaults where absent or invalid."""
    reads = F.coalesce(F.when(m["read_count"].rlike(r"^\d+$"), m["read_count"].cast("long")), F.lit(0))
    conf = F.when(m["confidence"].rlike(r"^-?\d+(\.\d+)?$"), m["confidence"].cast("double"))
    return F.struct(reads.alias("read_count"), F.coalesce(conf, F.lit(1.0)).alias("confidence"), topic_history(m["topic_history"]).alias("topic_history"), m["last_reviewed"].alias("last_reviewed"))


def heading_segments(c: Column) -> Column:
    return F.filter(F.transform(F.split(c, "/"), lambda x: F.trim(x)), lambda x: x != "")


def section_chain(c: Column) -> Column:
    """Cumulative paths: a, a / b, a / b / c."""
    parts = heading_segments(c)
    return F.when(F.size(parts) > 0, F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), " / "))).otherwise(F.array().cast("array<string>"))


def first_paragraph(c: Column, most: int = 200) -> Column:
    parts = F.filter(F.transform(F.split(c, r"\n\s*\n"), lambda x: F.trim(x)), lambda x: (x != "") & ~x.startswith("#"))
    return F.left(F.coalesce(F.get(parts, F.lit(0)), F.lit("")), F.lit(most))


def preview(c: Column, most: int = 200) -> Column:
    return F.when(F.length(c) > most, F.concat(F.left(c, F.lit(most)), F.lit("…"))).otherwise(c)


def strip_images(c: Column) -> Column:
    """Image references go; runs of blank lines shrink to one."""
    return F.trim(chain(c, (r"!\[[^\]]*\]\([^)]*\)", ""), (r"\n{3,}", "\n\n")))


def is_large(c: Column, limit: int = 1 << 20) -> Column:
    return F.octet_length(c) > limit


def token_estimate(c: Column) -> Column:
    """A quarter of the other characters, rounded up, and every CJK character."""
    cjk = F.regexp_count(c, F.lit(r"[　-〿㐀-䶿一-鿿豈-﫿＀-￯]"))
    return F.ceil((F.length(c) - cjk) / 4) + cjk


def canonicals(c: Column) -> Column:
    """Terms separated by commas or slashes, the first spelling of each."""
    parts = F.filter(F.transform(F.split(c, "[,/]"), lambda x: F.trim(x)), lambda x: x != "")
    return F.aggregate(parts, F.array().cast("array<string>"), lambda a, x: F.when(F.exists(a, lambda y: F.lower(y) == F.lower(x)), a).otherwise(F.array_append(a, x)))


def is_definitional(c: Column) -> Column:
    """Does a question ask what something is?"""
    q = F.regexp_replace(F.lower(F.trim(c)), r"[?!.]+$", "")
    tests = (r"^(what|who|which|where|when|whose|how)\s+(is|are|was|were|does|do|did)\s+", r"^(what|who|which|where|when)\s+.*" + word("is|are|was|were"), r"^define\s+", r"^what\s+does\s+\S+\s+mean", r"(?<![A-Za-z0-9_])is\s+[a-z0-9_-]+\s*[?.]?$")
    out = q.rlike(tests[0])
    for t in tests[1:]:
        out = out | q.rlike(t)
    return out


def lenient_json(c: Column, ddl: str) -> Column:
    """JSON as it is, else the fenced block, else from the first brace to the last."""
    fenced, outer = F.regexp_extract(c, r"```(?:json)?\s*([\s\S]*?)```", 1), F.regexp_extract(c, r"(\{[\s\S]*\})", 1)
    ok = lambda x: x.rlike(r"^\{[\s\S]*\}$")
    tried = lambda x: F.get(F.filter(F.array(x), ok), 0)  # noqa: E731  an element is made once, a repeated expression each time
    return F.from_json(F.coalesce(tried(F.trim(c)), tried(F.trim(fenced)), tried(outer)), ddl)


def ticket_ref(c: Column) -> Column:
    r = F.regexp_extract(c, r"(?<![A-Za-z0-9_])(G\d+\.S\d+\.T\d+)(?![A-Za-z0-9_])", 1)
    return F.when(r != "", r)


def eta(ms: Column) -> Column:
    s = F.round(ms / 1000).cast("long")
    return F.when(s < 60, F.format_string("%ds", s)).when(s < 3600, F.format_string("%dm %ds", F.floor(s / 60), s % 60)).otherwise(F.format_string("%dh %dm", F.floor(s / 3600), F.floor(s % 3600 / 60)))


def strip_html(c: Column) -> Column:
    return F.trim(chain(c, (r"<[^>]*>", ""), ("&quot;", '"'), ("&amp;", "&"), ("&#x27;", "'"), ("&lt;", "<"), ("&gt;", ">"), ("&nbsp;", " ")))


def clamp_level(c: Column) -> Column:
    return F.least(F.lit(6), F.greatest(F.lit(1), F.floor(c + F.lit(0.5)))).cast("int")


def heading(level: Column, text: Column) -> Column:
    return F.concat(F.repeat(F.lit("#"), clamp_level(level)), F.lit(" "), text)


def serialize_turn(role: Column, content: Column, thinking: Column, tool: Column) -> Column:
    some = lambda label, v, ok: F.when(ok & (F.coalesce(F.length(v), F.lit(0)) > 0), F.concat(F.lit(label), v))
    return F.concat_ws("\n", F.concat(role, F.lit(": "), content), some("thinking: ", thinking, role == "assistant"), some("tool output: ", tool, role.isin("assistant", "user")))


def relation_of(c: Column) -> Column:
    """A relation out of loose JSON: ``source`` or ``from``, ``target`` or ``to``, trimmed; keywords never null."""
    end = lambda r, a, b: F.trim(F.coalesce(r[a], r[b]))
    fields = lambda r: F.struct(end(r, "source", "from").alias("source"), end(r, "target", "to").alias("target"), F.coalesce(r["keywords"], F.array().cast("array<string>")).alias("keywords"))
    loose = lenient_json(c, "source string, target string, `from` string, `to` string, keywords array<string>")
    return F.get(F.transform(F.array(loose), fields), 0)  # parsed once for all fields
