"""Queries over text functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from weftmill.functions import text as X
from weftmill.plans.registry import MD, NL, TOKENS, markdown, query, table

_SLUG = "coalesce(nullif(left(regexp_replace(regexp_replace(lower({0}), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), 80), ''), 'document')"
_STEPS = [
    (r"^---\r?\n[\s\S]*?\r?\n---\r?\n?", ""), (r"<!--[\s\S]*?-->", " "), (r"!\[[^\]]*\]\([^)]*\)", " "), (r"\[([^\]]*)\]\([^)]*\)", r"\1"), (r"```[\s\S]*?```", " "), (r"`([^`]*)`", r" \1 "), (r"\*+", ""), (r"_+", ""),
    (r"(?m)^\s*#{1,6}\s+", ""), (r"(?m)^\s*>\s?", ""), (r"(?m)^\s*[-*+]\s+", ""), (r"(?m)^\s*\d+[.)]\s+", ""), (r"\|", " "), (r"\s+([.,;:!?])", r"\1"), (r"\s+", " "),
]


def _chain(x: str) -> str:
    for p, r in _STEPS:
        x = f"regexp_replace({x}, '{p}', '{r}', 'g')"
    return f"lower(trim({x}))"


@query(f"SELECT doc_id, sha256({_chain(MD)}) AS content_hash, length({_chain(MD)}) AS n FROM documents")
def txt1_normalize(spark, sf_dir):
    """Normalized text of each page, as its hash and length."""
    plain = X.normalize_markdown(F.col("md"))
    return markdown(table(spark, sf_dir, "documents")).select("doc_id", F.sha2(plain, 256).alias("content_hash"), F.length(plain).cast("long").alias("n"))


@query(f"WITH p AS (SELECT doc_id, string_split({_chain(MD)}, ' ') AS w FROM documents) SELECT doc_id, list_transform(range(1, len(w) + 1, 100), lambda s: sha256(array_to_string(w[s : s + 99], ' '))) AS hashes FROM p")
def txt2_chunk_hashes(spark, sf_dir):
    """Hashes of every hundred words."""
    return markdown(table(spark, sf_dir, "documents")).select("doc_id", X.chunk_hashes(X.normalize_markdown(F.col("md")), 100).alias("hashes"))


@query(f"""WITH h AS (SELECT doc_id, sha256({_chain(MD)}) AS content_hash FROM documents),
f AS (SELECT content_hash, min(doc_id) AS existing FROM h GROUP BY content_hash)
SELECT doc_id, existing < doc_id AS duplicate, CASE WHEN existing < doc_id THEN existing END AS existing_source FROM h JOIN f USING (content_hash)""")
def txt3_canonical(spark, sf_dir):
    """The first writer of equal content is canonical."""
    from weftmill.operators.dedup import canonical

    return canonical(markdown(table(spark, sf_dir, "documents")).select("doc_id", X.normalize_markdown(F.col("md")).alias("plain")))


@query(f"SELECT doc_id, len(t) AS n_tokens, len(list_distinct(t)) AS n_distinct FROM (SELECT doc_id, {TOKENS} AS t FROM documents)")
def txt4_tokens(spark, sf_dir):
    """Tokens and distinct tokens of each document."""
    t = X.tokens(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", F.size(t).cast("long").alias("n_tokens"), F.size(F.array_distinct(t)).cast("long").alias("n_distinct"))


@query("SELECT doc_id, translate(lower(trim(text)), 'áàâäãåçéèêëíìîïñóòôöõúùûüýÿ', 'aaaaaaceeeeiiiinooooouuuuyy') AS folded FROM documents")
def txt4_fold(spark, sf_dir):
    """Query folding of each whole document."""
    return table(spark, sf_dir, "documents").select("doc_id", X.fold_query(F.col("text")).alias("folded"))


@query("""SELECT conv_id, turn, role AS type, CASE WHEN turn % 2 = 0 THEN role || '/t' || turn END AS topic, 'T' || conv_id AS title, 'B' || turn AS body FROM conversations""")
def txt5_frontmatter(spark, sf_dir):
    """Front matter written for each turn, and read back as a map."""
    keys = F.when(F.col("turn") % 2 == 0, F.array(F.lit("title"), F.lit("type"), F.lit("topic"))).otherwise(F.array(F.lit("title"), F.lit("type")))
    values = F.array(F.concat(F.lit('"T'), "conv_id", F.lit('"')), "role", F.concat("role", F.lit("/t"), "turn"))
    values = F.slice(values, 1, F.size(keys))
    page = X.render_frontmatter(keys, values, F.concat(F.lit("B"), "turn"))
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", page.alias("page"))
    m = X.frontmatter(F.col("page"))
    return rows.select("conv_id", "turn", m["type"].alias("type"), m["topic"].alias("topic"), m["title"].alias("title"), X.body(F.col("page")).alias("body"))


@query("SELECT o_orderkey, CAST(o_orderkey % 7 AS BIGINT) AS read_count, CASE WHEN o_orderkey % 3 = 0 THEN 1.0 ELSE (o_orderkey % 10) / 10.0 END AS confidence, len(list_distinct([o_orderstatus, o_orderpriority])) AS n_topics FROM orders")
def txt9_lifecycle(spark, sf_dir):
    """Lifecycle fields parsed from front-matter strings, with defaults."""
    m = F.create_map(F.lit("read_count"), F.concat((F.col("o_orderkey") % 7).cast("string")), F.lit("confidence"), F.when(F.col("o_orderkey") % 3 == 0, "n/a").otherwise((F.col("o_orderkey") % 10 / 10).cast("string")), F.lit("topic_history"), F.concat(F.lit("["), "o_orderstatus", F.lit(", "), "o_orderpriority", F.lit("]")))
    life = X.lifecycle(m)
    return table(spark, sf_dir, "orders").select("o_orderkey", life["read_count"].alias("read_count"), life["confidence"].alias("confidence"), F.size(F.array_distinct(life["topic_history"])).cast("long").alias("n_topics"))


@query(f"SELECT p_partkey, {_SLUG.format('p_name')} AS slug, {_SLUG.format('p_type')} AS doc_id FROM part")
def txt20_slug(spark, sf_dir):
    """Slugs of names, and document ids of paths."""
    return table(spark, sf_dir, "part").select("p_partkey", X.slugify(F.col("p_name")).alias("slug"), X.document_id(F.col("p_name"), F.concat(F.lit("raw/"), F.replace("p_type", F.lit("/"), F.lit(" ")), F.lit(".MD"))).alias("doc_id"))


@query(f"SELECT doc_id, source AS title, CASE WHEN length(text) > 200 THEN left(text, 200) || '…' ELSE text END AS preview, coalesce(left(trim(list_filter(string_split(text, {NL}), lambda x: trim(x) <> '' AND NOT starts_with(x, '#'))[1]), 200), '') AS summary FROM documents")
def txt19_titles(spark, sf_dir):
    """Page title, preview and first-paragraph summary of the markdown view."""
    rows = markdown(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", X.page_title(F.col("md")).alias("title"), X.preview(F.col("text")).alias("preview"), X.first_paragraph(F.col("md")).alias("summary"))


@query("SELECT DISTINCT n_nationkey, [r_name, r_name || ' / ' || n_name, r_name || ' / ' || n_name || ' / x'] AS chain FROM nation JOIN region ON n_regionkey = r_regionkey")
def txt22_section_chain(spark, sf_dir):
    """Cumulative section paths of a heading path."""
    rows = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return rows.select("n_nationkey", X.section_chain(F.concat("r_name", F.lit(" / "), "n_name", F.lit("/ x "))).alias("chain")).distinct()


@query("""WITH c AS (SELECT p_partkey, unnest(t) AS c, generate_subscripts(t, 1) AS i FROM (SELECT p_partkey, string_split_regex(p_type || ', ' || upper(p_type) || '/ ' || p_brand || ' ,, ' || coalesce(p_name, '') || '/' || lower(p_type), '[,/]') AS t FROM part)),
f AS (SELECT p_partkey, arg_min(trim(c), i) AS first, min(i) AS place FROM c WHERE trim(c) <> '' GROUP BY p_partkey, lower(trim(c))) SELECT p_partkey, list(first ORDER BY place) AS canonicals FROM f GROUP BY p_partkey""")
def txt25_canonicals(spark, sf_dir):
    """Canonical terms: the first spelling of each."""
    rows = table(spark, sf_dir, "part")
    return rows.select("p_partkey", X.canonicals(F.concat("p_type", F.lit(", "), F.upper("p_type"), F.lit("/ "), "p_brand", F.lit(" ,, "), "p_name", F.lit("/"), F.lower("p_type"))).alias("canonicals"))


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def txt26_lenient_json(spark, sf_dir):
    """JSON found plain, fenced, or between other words."""
    wrapped = F.when(F.col("event_id") % 3 == 0, F.col("props")).when(F.col("event_id") % 3 == 1, F.concat(F.lit("```json\n"), "props", F.lit("\n```"))).otherwise(F.concat(F.lit("Here: "), "props", F.lit(" done")))
    return table(spark, sf_dir, "events").select("event_id", X.lenient_json(wrapped, "k long")["k"].alias("k"))


@query("SELECT o_orderkey, 'G1.S' || (o_custkey % 9) || '.T' || o_orderkey AS ref FROM orders")
def txt28_ticket_ref(spark, sf_dir):
    """Ticket references found in sentences."""
    sentence = F.concat(F.lit("see G1.S"), F.col("o_custkey") % 9, F.lit(".T"), "o_orderkey", F.lit(" (and notG1.S2.T3x)"))
    return table(spark, sf_dir, "orders").select("o_orderkey", X.ticket_ref(sentence).alias("ref"))


@query("SELECT conv_id, turn, CAST(ceil(length(text) / 4.0) AS BIGINT) AS tokens, role || ': ' || text AS line FROM conversations")
def txt31_turns(spark, sf_dir):
    """Token estimate and serialized form of each turn."""
    none = F.lit(None).cast("string")
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", X.token_estimate(F.col("text")).alias("tokens"), X.serialize_turn(F.col("role"), F.col("text"), none, none).alias("line"))


@query("""WITH s AS (SELECT o_orderkey, CAST(round(o_totalprice) AS BIGINT) AS s FROM orders)
SELECT o_orderkey, CASE WHEN s < 60 THEN s || 's' WHEN s < 3600 THEN (s // 60) || 'm ' || (s % 60) || 's' ELSE (s // 3600) || 'h ' || (s % 3600 // 60) || 'm' END AS eta FROM s""")
def txt32_eta(spark, sf_dir):
    """Remaining times as people read them."""
    return table(spark, sf_dir, "orders").select("o_orderkey", X.eta(F.round("o_totalprice").cast("long") * 1000).alias("eta"))


@query("SELECT c_custkey, sha256(c_name) AS token FROM customer")
def txt33_hash_token(spark, sf_dir):
    """Token hashes."""
    return table(spark, sf_dir, "customer").select("c_custkey", F.sha2("c_name", 256).alias("token"))


@query("SELECT item_id, regexp_matches(q, '^(what|who|which|where|when|whose|how)\\s+(is|are|was|were|does|do|did)\\s+') OR regexp_matches(q, '^(what|who|which|where|when)\\s+.*\\b(is|are|was|were)\\b.*') OR regexp_matches(q, '^define\\s+') OR regexp_matches(q, '^what\\s+does\\s+\\S+\\s+mean') OR regexp_matches(q, '\\bis\\s+[a-z0-9_-]+\\s*[?.]?$') AS definitional FROM (SELECT item_id, regexp_replace(lower(trim(CASE item_id % 4 WHEN 0 THEN 'What is ' WHEN 1 THEN 'define ' WHEN 2 THEN 'List ' ELSE 'Which one ' END || split_part(text, ' ', 1) || '?')), '[?!.]+$', '') AS q FROM benchmark)")
def flt14_definitional(spark, sf_dir):
    """Questions that ask what something is."""
    lead = F.when(F.col("item_id") % 4 == 0, "What is ").when(F.col("item_id") % 4 == 1, "define ").when(F.col("item_id") % 4 == 2, "List ").otherwise("Which one ")
    return table(spark, sf_dir, "benchmark").select("item_id", X.is_definitional(F.concat(lead, F.get(F.split("text", " "), F.lit(0)), F.lit("?"))).alias("definitional"))


@query("SELECT doc_id, lang || '/' || source AS topic, regexp_matches(lang || '/' || source, '^[a-z0-9]+(?:-[a-z0-9]+)*(?:/[a-z0-9]+(?:-[a-z0-9]+)*)*$') AS valid FROM documents")
def flt7_topics(spark, sf_dir):
    """Topic normalization of loosely written topics."""
    raw = F.concat(F.lit(" /"), F.upper("lang"), F.lit("//- "), "source", F.lit("/ "))
    t = X.normalize_topic(raw)
    return table(spark, sf_dir, "documents").select("doc_id", t.alias("topic"), X.is_topic(t).alias("valid"))


@query(r"SELECT page_id, regexp_extract(url, '^[a-z]+://([^/?#]+)', 1) AS host FROM pages")
def src4_hosts(spark, sf_dir):
    """Hosts of page addresses."""
    return table(spark, sf_dir, "pages").select("page_id", F.parse_url("url", F.lit("HOST")).alias("host"))


@query()
def src4_stems(spark, sf_dir):
    """Safe stems of page addresses."""
    return table(spark, sf_dir, "pages").select("page_id", X.url_stem(F.col("url")).alias("stem"))


@query("SELECT page_id, regexp_replace(html, '<[^>]*>', '', 'g') AS t FROM pages", name="src14_strip_html")
def src14_strip_html(spark, sf_dir):
    """Tags off."""
    return table(spark, sf_dir, "pages").select("page_id", F.regexp_replace("html", r"<[^>]*>", "").alias("t"))
