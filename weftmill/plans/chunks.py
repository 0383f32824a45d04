"""Queries over blocks, sections and chunks."""

from __future__ import annotations

from pyspark.sql import functions as F

from weftmill.operators import chunking as C
from weftmill.plans.registry import MD, NL, markdown, query, table

# the markdown view has two headings, then one paragraph for each non-blank line of the text
_LINES = f"SELECT doc_id, lang, source, p, trim(line) AS line FROM (SELECT doc_id, lang, source, generate_subscripts(l, 1) AS p, unnest(l) AS line FROM (SELECT doc_id, lang, source, string_split(text, {NL}) AS l FROM documents)) WHERE trim(line) <> ''"


def _blocks(spark, sf_dir):
    return C.blocks(markdown(table(spark, sf_dir, "documents")))


@query(f"SELECT doc_id, CAST(2 + count(line) AS BIGINT) AS n_blocks, CAST(2 AS BIGINT) AS n_headings FROM (SELECT doc_id FROM documents) LEFT JOIN ({_LINES}) USING (doc_id) GROUP BY doc_id")
def txt10_blocks(spark, sf_dir):
    """Blocks and headings of each page."""
    return _blocks(spark, sf_dir).groupBy("doc_id").agg(F.count("*").alias("n_blocks"), F.count_if(F.col("kind") == "heading").alias("n_headings"))


@query(f"SELECT doc_id, 'c' || row_number() OVER (PARTITION BY doc_id ORDER BY p) AS chunk_id, source || ' / ' || lang AS heading_path, line AS text FROM ({_LINES})")
def txt12_chunks(spark, sf_dir):
    """Paragraph chunks with their heading path."""
    return C.chunks(_blocks(spark, sf_dir))


@query(f"WITH l AS ({_LINES}) SELECT doc_id, CAST(1 AS BIGINT) AS section, any_value(source) AS title, CAST(2 + count(line) AS BIGINT) AS n_blocks, CAST(any_value(strlen(source) + strlen(lang)) + coalesce(sum(strlen(line)), 0) AS BIGINT) AS bytes FROM documents d LEFT JOIN (SELECT doc_id, line FROM l) USING (doc_id) GROUP BY doc_id")
def txt13_sections(spark, sf_dir):
    """Sections at level-one headings."""
    return C.sections(_blocks(spark, sf_dir))


@query("SELECT doc_id, 2 AS split_at FROM documents")
def txt15_split_level(spark, sf_dir):
    """The heading level to split at: two where level one gives one section."""
    return C.split_level(_blocks(spark, sf_dir))


@query(f"""WITH RECURSIVE l AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY p) AS i, strlen(line) AS s FROM ({_LINES})),
w AS (SELECT doc_id, i, s AS used, 0 AS grp FROM l WHERE i = 1
      UNION ALL SELECT l.doc_id, l.i, CASE WHEN w.used > 0 AND w.used + l.s > 2000 THEN l.s ELSE w.used + l.s END, CASE WHEN w.used > 0 AND w.used + l.s > 2000 THEN w.grp + 1 ELSE w.grp END FROM w JOIN l ON l.doc_id = w.doc_id AND l.i = w.i + 1)
SELECT doc_id, CAST(max(grp) + 1 AS INTEGER) AS n_groups, CAST(max(i) AS BIGINT) AS n_paragraphs FROM w GROUP BY doc_id""")
def win6_size_packing(spark, sf_dir):
    """Greedy packing of paragraphs into groups of 2,000 bytes."""
    c = C.chunks(_blocks(spark, sf_dir)).withColumn("i", F.regexp_extract("chunk_id", r"(\d+)", 1).cast("int"))
    rows = c.groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", F.octet_length("text").alias("s")))), lambda x: x["s"]).alias("sizes"))
    return rows.select("doc_id", (F.array_max(C.greedy_groups(F.col("sizes"), 2000)) + 1).alias("n_groups"), F.size("sizes").cast("long").alias("n_paragraphs"))


@query("SELECT conv_id, turn, CAST((row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1) // 3 AS INTEGER) AS batch FROM conversations")
def win7_batches(spark, sf_dir):
    """Turns in batches of three."""
    return C.batches(table(spark, sf_dir, "conversations"), 3, "turn", "conv_id").select("conv_id", "turn", "batch")


@query(f"SELECT doc_id, strlen({MD}) > 16384 AS large FROM documents")
def txt17_routing(spark, sf_dir):
    """Large and small documents by UTF-8 size."""
    from weftmill.functions.text import is_large

    return markdown(table(spark, sf_dir, "documents")).select("doc_id", is_large(F.col("md"), 16384).alias("large"))


@query(f"SELECT doc_id, sha256('###### ' || lang || {NL} || {NL} || '# ' || source) AS h FROM documents")
def txt14_rebuild(spark, sf_dir):
    """Markdown rebuilt with clamped heading levels."""
    from weftmill.functions.text import heading

    md = F.concat(heading(F.lit(9.2), F.col("lang")), F.lit("\n\n"), heading(F.lit(-3.0), F.col("source")))
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(md, 256).alias("h"))


@query("SELECT doc_id, pos, kind, level, text FROM (SELECT doc_id, 0 AS pos, 'heading' AS kind, 3 AS level, source AS text FROM documents UNION ALL SELECT doc_id, 1, 'heading', 2, 'renamed' FROM documents UNION ALL SELECT doc_id, 2, 'paragraph', 0, 'added' FROM documents)")
def txt11_patches(spark, sf_dir):
    """Patches on the two headings of each page: a new level, a new name, an insertion; wrong ones are ignored."""
    found = _blocks(spark, sf_dir).where("kind = 'heading'")
    rows = [(1, "set_level", 0, None, 3), (2, "set_heading", 1, "renamed", None), (3, "set_text", 0, "ignored: wrong kind", None), (4, "insert_after", 1, "added", None), (5, "delete", 99, None, None)]
    kinds = {"seq": "int", "op": "string", "index": "int", "text": "string", "level": "int"}
    ops = F.array(*[F.struct(*[F.lit(v).cast(t).alias(n) for v, (n, t) in zip(r, kinds.items(), strict=True)]) for r in rows])
    return C.apply_patches(found, table(spark, sf_dir, "documents").select("doc_id", F.explode(ops).alias("p")).select("doc_id", "p.*"))


@query("SELECT doc_id, 0 AS pos, source AS text, 1 AS level FROM documents UNION ALL SELECT doc_id, 7, lang, 2 FROM documents UNION ALL SELECT doc_id, 1, 'unknown', 4 FROM documents")
def jn18_heading_alignment(spark, sf_dir):
    """Levels of refined headings taken from the source, by position, then by text."""
    source = _blocks(spark, sf_dir).where("kind = 'heading'").select("doc_id", "pos", "text", "level")
    docs = table(spark, sf_dir, "documents")
    heads = [F.struct(F.lit(p).alias("pos"), t.alias("text"), F.lit(n).alias("level")) for p, t, n in ((0, F.col("source"), 5), (7, F.col("lang"), 5), (1, F.lit("unknown"), 4))]
    refined = docs.select("doc_id", F.explode(F.array(*heads)).alias("h")).select("doc_id", "h.*")
    return C.align_headings(source, refined)


@query(f"SELECT doc_id, sha256('a' || {NL} || '*' || source || '*' || {NL} || 'b') AS h FROM documents")
def src5_descriptions(spark, sf_dir):
    """Image descriptions in italics."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("a\n<!-- image-description -->\n"), "source", F.lit("\n<!-- /image-description -->\nb")).alias("md"))
    return C.mark_descriptions(docs).select("doc_id", F.sha2("md", 256).alias("h"))


@query("SELECT doc_id, 'see  end' || chr(10) || chr(10) || lang AS t FROM documents")
def txt18_strip_images(spark, sf_dir):
    """Image references stripped."""
    from weftmill.functions.text import strip_images

    return table(spark, sf_dir, "documents").select("doc_id", strip_images(F.concat(F.lit("see ![x](a.png) end\n\n\n\n"), "lang")).alias("t"))
