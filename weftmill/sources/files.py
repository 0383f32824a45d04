"""Boards, wikis and parse inputs as files: scans and sinks over any Hadoop file system."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftmill.functions import text as X
from weftmill.functions.udf import parse_board

# Extensions of documents that can be parsed.
EXTENSIONS = (
    "pdf", "docx", "pptx", "xlsx", "html", "htm", "xhtml", "md", "markdown", "txt", "csv", "adoc", "asciidoc", "asc", "png", "jpg", "jpeg", "tif", "tiff", "bmp", "webp", "xml", "json", "wav", "mp3", "vtt", "odt", "rtf", "epub",
)


def supported(path: F.Column) -> F.Column:
    return F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1)).isin(*EXTENSIONS)


def whole_files(spark: SparkSession, root: str, glob: str = "*") -> DataFrame:
    """``path, text`` of the files below a folder."""
    rows = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", glob).text(root, wholetext=True)
    return rows.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def scan_board(spark: SparkSession, root: str, spec_ref: str | None = None, include_body: bool = False) -> DataFrame:
    """Board files as rows ``ref, layer, path, frontmatter, error[, body]``; ``spec_ref`` prunes paths before the parse.

    Goals are ``Gn/Goal.md``, specs ``Gn/Sn/Spec.md``, tickets ``Gn/Sn/Tn.md`` or ``Gn/Sn/Tn/Tn.md``. A file that doesn't
    parse is a row with an error.
    """
    rows = whole_files(spark, root, "*.md")
    ticket = F.regexp_extract("path", r"/(G\d+)/(S\d+)/(?:T\d+/)?(T\d+)\.md$", 3)
    goal, spec = F.regexp_extract("path", r"/(G\d+)/", 1), F.regexp_extract("path", r"/G\d+/(S\d+)/", 1)
    layer = F.when(ticket != "", "T").when(F.col("path").rlike(r"/G\d+/S\d+/Spec\.md$"), "S").when(F.col("path").rlike(r"/G\d+/Goal\.md$"), "G")
    ref = F.concat_ws(".", goal, F.when(layer != "G", spec), F.when(layer == "T", ticket))
    rows = rows.withColumn("layer", layer).where("layer is not null").withColumn("ref", ref)
    if spec_ref:
        rows = rows.where((F.col("ref") == spec_ref) | F.col("ref").startswith(spec_ref + ".") | (F.col("ref") == spec_ref.split(".")[0]))
    rows = rows.withColumn("parsed", parse_board("text"))
    told = F.get_json_object("parsed.frontmatter", "$.layer")
    error = F.when(F.col("parsed.frontmatter") == "{}", "no front matter").when(~told.eqNullSafe(F.col("layer")), "layer doesn't fit the path")
    out = ["ref", "layer", "path", F.col("parsed.frontmatter").alias("frontmatter"), error.alias("error")]
    return rows.select(*out, *([F.col("parsed.body").alias("body")] if include_body else []))


def wiki_pages(spark: SparkSession, root: str) -> DataFrame:
    """``path, type, topic, title, text`` of wiki pages; hidden files and the index, overview and log pages are left out."""
    rows = whole_files(spark, root, "*.md").where(~F.col("path").rlike(r"/\.[^/]*$|/(index|overview|log)\.md$|/\.[^/]+/"))
    m = X.frontmatter(F.col("text"))
    name = F.element_at(F.split("path", "/"), -1)
    return rows.select("path", m["type"].alias("type"), m["topic"].alias("topic"), F.coalesce(m["title"], X.page_title(X.body(F.col("text"))), X.stem_title(name)).alias("title"), "text")


def write_wiki(pages: DataFrame, root: str, mode: str = "errorifexists") -> None:
    """Pages (category, topic, folder, title, body) with front matter, as Parquet partitioned by their folder; for files see ``pagefiles``.

    A root that exists is an error unless ``mode`` says ``append`` or ``overwrite``.
    """
    keys, values = F.array(F.lit("type"), F.lit("title"), F.lit("topic")), F.array("category", "title", F.coalesce("topic", F.lit("")))
    pages.withColumn("page", X.render_frontmatter(keys, values, F.col("body"))).withColumn("dir", F.coalesce("topic", "folder")).write.mode(mode).partitionBy("dir").parquet(root)


def write_chunks(chunks: DataFrame, root: str, key: str = "doc_id", mode: str = "errorifexists") -> DataFrame:
    """Chunks as Parquet; returns the small reference: chunks and bytes of each document. ``mode`` as in ``write_wiki``."""
    chunks.write.mode(mode).parquet(root)
    back = chunks.sparkSession.read.parquet(root)
    return back.groupBy(key).agg(F.count("*").alias("chunks"), F.sum(F.octet_length("text")).alias("bytes")).withColumn("location", F.lit(root))


def search_results(pages: DataFrame, key: str = "page_id", html: str = "html", k: int | None = None) -> DataFrame:
    """``key, position, title, url, snippet`` of search-result pages: redirects decoded, tags and entities stripped.

    Rows without title, snippet or an http address are dropped.
    """
    blocks = F.filter(F.transform(F.split(html, 'class="result__a"'), lambda x, i: F.when(i > 0, x)), lambda x: x.isNotNull())
    rows = pages.select(key, F.posexplode(blocks).alias("position", "block"))
    title = X.strip_html(F.regexp_extract("block", r">\s*([\s\S]*?)\s*</a>", 1))
    snippet = X.strip_html(F.regexp_extract("block", r'class="result__snippet"[^>]*>([\s\S]*?)</a>', 1))
    url = F.try_url_decode(F.regexp_extract(F.regexp_extract("block", r'href="([^"]*)"', 1), r"[?&]uddg=([^&]+)", 1))
    out = rows.select(key, "position", title.alias("title"), url.alias("url"), snippet.alias("snippet")).where((F.col("title") != "") & (F.col("snippet") != "") & F.col("url").rlike("^https?://"))
    return out.where(F.col("position") < k) if k else out
