"""One query for each operator of this package, over whole tables, and its SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from weftmill.session import ship_package

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship_package(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(sql: str | None = None):
    """Register a query under its function's name."""

    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            SQL[fn.__name__] = sql
        return fn

    return add


@query()
def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chain probabilities and the verdict for every document."""
    from weftmill.llm import toxicity

    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


@query()
def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document."""
    from weftmill.llm import quality

    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query()
def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    from weftmill.llm import simhash

    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


@query()
def op3_token_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token records of every document, as read back from the files."""
    from weftmill.llm import tokenbin

    return tokenbin.round_trip(table(spark, sf_dir, "documents"))


@query()
def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document packed into windows of up to 1024 ids."""
    from weftmill.llm import packing

    return packing.pack(table(spark, sf_dir, "documents"))


_WORDS = r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'"
_LOWER_AZ = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_OP6_SQL = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all({_LOWER_AZ}, {_WORDS}) AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all({_LOWER_AZ}, {_WORDS}) AS w FROM benchmark),
q AS (SELECT DISTINCT item, least(13, len(w)) AS size, array_to_string(w[i : i + least(13, len(w)) - 1], ' ') AS phrase
      FROM (SELECT item, w, unnest(range(1, greatest(1, len(w) - 12) + 1)) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT size FROM q),
g AS (SELECT doc_id, size, i, array_to_string(w[i : i + size - 1], ' ') AS phrase
      FROM (SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM d, sizes WHERE len(w) >= size)),
m AS (SELECT doc_id, item, size, i FROM g JOIN q USING (size, phrase)),
h AS (SELECT doc_id, count(DISTINCT i + k) AS n_hit FROM (SELECT doc_id, i, unnest(range(0, size)) AS k FROM (SELECT DISTINCT doc_id, i, size FROM m)) GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM m) GROUP BY doc_id),
x AS (SELECT doc_id, generate_subscripts(w, 1) AS p, unnest(w) AS term FROM d),
df AS (SELECT term, count(DISTINCT doc_id) AS n FROM x GROUP BY term),
u AS (SELECT size, phrase, item, unnest(list_distinct(string_split(phrase, ' '))) AS term FROM q),
k AS (SELECT u.size, u.phrase, u.item, u.term, row_number() OVER (PARTITION BY u.size, u.phrase, u.item ORDER BY df.n, encode(u.term)) AS r, count(*) OVER (PARTITION BY u.size, u.phrase, u.item) AS n,
             min(coalesce(df.n, 0)) OVER (PARTITION BY u.size, u.phrase, u.item) AS least FROM u LEFT JOIN df USING (term)),
c AS (SELECT k.size, k.phrase, k.item, x.doc_id, x.p, least(k.n, 4) AS wanted FROM k JOIN x USING (term) WHERE k.r = 1 AND k.least > 0),
o AS (SELECT c.size, c.phrase, c.item, c.doc_id, c.p, c.wanted FROM c JOIN k ON k.size = c.size AND k.phrase = c.phrase AND k.item = c.item AND k.r BETWEEN 2 AND 4 JOIN x ON x.doc_id = c.doc_id AND x.term = k.term AND abs(x.p - c.p) <= 26
      GROUP BY c.size, c.phrase, c.item, c.doc_id, c.p, c.wanted HAVING count(DISTINCT k.term) = c.wanted - 1),
e AS (SELECT doc_id, item FROM o UNION SELECT doc_id, item FROM c WHERE wanted = 1),
a AS (SELECT doc_id, count(*) AS n_near FROM (SELECT doc_id, item FROM e EXCEPT SELECT DISTINCT doc_id, item FROM m) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(h.n_hit, 0) AS n_hit, coalesce(t.n_items, 0) AS n_items,
       sha256(coalesce(t.items, '')) AS items_sha256, coalesce(h.n_hit, 0) > 0 AND 20 * coalesce(h.n_hit, 0) >= len(d.w) AS contaminated, coalesce(a.n_near, 0) AS n_near
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN t USING (doc_id) LEFT JOIN a USING (doc_id)
"""


@query(_OP6_SQL)
def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark windows in every document, and the items that are only near."""
    from weftmill.llm import decontam

    return decontam.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


_OP9_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT doc_id, i, array_to_string(w[i : i + 12], ' ') AS phrase FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM d WHERE len(w) >= 13)),
f AS (SELECT phrase, min(doc_id) AS least FROM g GROUP BY phrase),
r AS (SELECT DISTINCT doc_id, i + k AS p FROM (SELECT g.doc_id, g.i, unnest(range(0, 13)) AS k FROM g JOIN f USING (phrase) WHERE f.least < g.doc_id)),
x AS (SELECT doc_id, generate_subscripts(w, 1) AS p, unnest(w) AS word FROM d),
k AS (SELECT x.doc_id, string_agg(word, ' ' ORDER BY p) AS kept, count(*) AS n FROM x LEFT JOIN r USING (doc_id, p) WHERE r.p IS NULL GROUP BY x.doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(len(d.w) AS BIGINT) - coalesce(k.n, 0) AS n_removed, sha256(coalesce(k.kept, '')) AS kept_sha256
FROM d LEFT JOIN k USING (doc_id)
"""


@query(_OP9_SQL)
def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document that repeat a passage of an earlier one."""
    from weftmill.llm import substring

    return substring.report(table(spark, sf_dir, "documents"))


_OP10_SQL = """
WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_reduce(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2]), lambda a, b: a + b) AS score
      FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0),
r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""


@query(_OP10_SQL)
def op10_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest vectors of every twentieth vector."""
    from weftmill.llm import ann

    return ann.search(table(spark, sf_dir, "embeddings"))


@query()
def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in every document, also below layers of encoding."""
    from weftmill.llm import secretscan

    return secretscan.report(table(spark, sf_dir, "documents"))


@query()
def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every document."""
    from weftmill.llm import pii

    return pii.report(table(spark, sf_dir, "documents"))


def _op11_sql(rounds: int = 4) -> str:
    """The rounds written out: each assigns all parts and replaces the entries that were used."""
    nearest = """SELECT p.r, p.j, min(list_dot_product(p.e, p.e) - 2 * list_dot_product(p.e, c.e) + list_dot_product(c.e, c.e)) AS d,
      arg_min(c.i, (list_dot_product(p.e, p.e) - 2 * list_dot_product(p.e, c.e) + list_dot_product(c.e, c.e)) * 256 + c.i) AS i FROM p JOIN {c} c USING (j) GROUP BY p.r, p.j"""
    steps = []
    for k in range(rounds):
        steps.append(f"""a{k} AS MATERIALIZED ({nearest.format(c=f"c{k}")}),
m{k} AS (SELECT j, i, list(floor(s / n) ORDER BY q) AS e FROM (SELECT a.j, a.i, x.q, sum(x.v) AS s, count(*) AS n FROM a{k} a JOIN x USING (r, j) GROUP BY a.j, a.i, x.q) GROUP BY j, i),
c{k + 1} AS MATERIALIZED (SELECT c.j, c.i, coalesce(m.e, c.e) AS e FROM c{k} c LEFT JOIN m{k} m USING (j, i))""")
    return f"""
WITH k AS (SELECT row_number() OVER (ORDER BY vec_id) AS r, vec_id, label, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS v
           FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS MATERIALIZED (SELECT r, j, v[j * len(v) // 4 + 1 : (j + 1) * len(v) // 4] AS e FROM k, range(4) AS t(j)),
x AS MATERIALIZED (SELECT r, j, generate_subscripts(e, 1) AS q, unnest(e) AS v FROM p),
c0 AS MATERIALIZED (SELECT j, r - 1 AS i, e FROM p WHERE r <= 256),
{",".join(steps)},
z AS MATERIALIZED ({nearest.format(c=f"c{rounds}")}),
o AS (SELECT k.vec_id, k.label, string_agg(lpad(lower(to_hex(z.i)), 2, '0'), '' ORDER BY z.j) AS code, CAST(sum(z.d) AS BIGINT) AS error FROM k JOIN z USING (r) GROUP BY k.r, k.vec_id, k.label),
s AS (SELECT sha256(string_agg(CAST(CAST(v AS BIGINT) AS VARCHAR), ',' ORDER BY j, i, q)) AS sha FROM (SELECT j, i, generate_subscripts(e, 1) AS q, unnest(e) AS v FROM c{rounds}))
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, sha AS codebooks_sha256 FROM o, s
"""


@query(_op11_sql())
def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes, errors and codebooks of all vectors."""
    from weftmill.llm import vectorcodes

    return vectorcodes.compress(table(spark, sf_dir, "embeddings"))


_OP12_SQL = r"""
WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
           CAST('0x' || substr(md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 15) AS BIGINT) AS place FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, 3 * CAST(sum(size) AS BIGINT) AS cap, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS w FROM d GROUP BY source),
r AS (SELECT *, row_number() OVER o AS k, (SELECT CAST(sum(source_size) AS BIGINT) FROM s) - coalesce(CAST(sum(cap) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS BIGINT), 0) AS words_left,
             CAST(sum(w) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS BIGINT) AS over FROM s WINDOW o AS (ORDER BY cap / w, source NULLS LAST)),
f AS (SELECT words_left, over FROM r WHERE CAST(w AS HUGEINT) * words_left <= CAST(cap AS HUGEINT) * over ORDER BY k LIMIT 1),
t AS (SELECT s.source, source_size, CASE WHEN CAST(w AS HUGEINT) * words_left > CAST(cap AS HUGEINT) * over THEN CAST(cap AS DOUBLE) ELSE CAST(w * words_left AS DOUBLE) / CAST(over AS DOUBLE) END AS target FROM s, f),
b AS (SELECT d.*, t.source_size, t.target, CAST(sum(size) OVER (PARTITION BY d.source ORDER BY place, doc_id NULLS FIRST, size ROWS UNBOUNDED PRECEDING) AS BIGINT) - size AS begin
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
q AS (SELECT *, begin + pass * source_size AS since FROM b, range(3) AS e(pass) WHERE size > 0 AND begin + pass * source_size < target),
g AS (SELECT doc_id, source, size, CAST(sum(size) OVER (ORDER BY CAST(since + size AS DOUBLE) / target, place, source NULLS LAST, doc_id NULLS FIRST, size, pass ROWS UNBOUNDED PRECEDING) AS BIGINT) AS upto FROM q),
u AS (SELECT doc_id, source, size, CAST(sum(greatest(0, least(size, (SELECT sum(size) FROM d) - upto + size))) AS BIGINT) AS taken FROM g GROUP BY doc_id, source, size)
SELECT b.doc_id, b.size, b.source_size, b.target, coalesce(u.taken, 0) AS taken FROM b LEFT JOIN u ON b.doc_id IS NOT DISTINCT FROM u.doc_id AND b.source IS NOT DISTINCT FROM u.source AND b.size = u.size
"""


@query(_OP12_SQL)
def op12_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that the mix takes of every document."""
    from weftmill.llm import mixing

    return mixing.mix(table(spark, sf_dir, "documents"))


def _op13_sql() -> str:
    """The programme with whole strings: all macro edits of a turn, the least (cost, letters) for each state."""
    after = {"": ("u", "a"), "s": ("u", "a"), "u": ("a",), "a": ("u",)}
    macros = []
    for q, runs in after.items():
        for n in range(len(runs) + 1):
            at, put = (runs[n - 1] if n else q), ["user:" if x == "u" else "assistant:" for x in runs[:n]]
            turn = "a" if at == "u" else "u"
            role = "assistant" if turn == "a" else "user"
            keep = "i IN ('u', 's')" if at == "" else f"i = '{turn}'"
            for letter, to, cost, when, line in (("D", f"'{at}'", "3", "TRUE", "[]"), ("R", f"'{turn}'", "2 + t", "NOT g", f"['{role}:' || text]"), ("K", "i", "t + 0", f"NOT g AND {keep}", "[role || ':' || text]")):
                macros.append(f"SELECT c, n, {to} AS q, cost + {2 * n} + {cost} AS cost, letters || '{'I' * n}{letter}' AS letters, list_concat(list_concat(lines, CAST({put} AS VARCHAR[])), CAST({line} AS VARCHAR[])) AS lines FROM x WHERE q = '{q}' AND {when}")
    return rf"""
WITH RECURSIVE k AS (SELECT dense_rank() OVER (ORDER BY conv_id NULLS FIRST) AS c, conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
  xor(list_reduce(list_concat([CAST(4294967295 AS BIGINT)], list_transform(string_split(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '), ''), lambda x: CAST(ascii(x) AS BIGINT))),
    lambda acc, b: xor(acc >> 8, list_reduce(list_concat([xor(acc, b) & 255], [CAST(0 AS BIGINT), 0, 0, 0, 0, 0, 0, 0]), lambda r, z: xor(r >> 1, (r & 1) * 3988292384)))), 4294967295) % 20 AS f FROM conversations),
d AS (SELECT c, turn, CASE WHEN f = 4 THEN 'user' ELSE role END AS role, CASE f WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(CASE WHEN f = 3 THEN [1, 2] ELSE [1] END) AS copy FROM k WHERE f <> 0),
o AS (SELECT *, row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, sha256(length(role) || ':' || role || text)) AS n, left(role, 1) AS i, regexp_extract_all(text, '[^ 	-]') AS w FROM d),
e AS (SELECT *, CASE WHEN len(w) = 0 THEN 1 WHEN row_number() OVER (PARTITION BY c, role, text ORDER BY n) > 1 THEN 2 WHEN w[-1] NOT IN ('.', '!', '?') THEN 3 ELSE 0 END AS fault, lag(i) OVER (PARTITION BY c ORDER BY n) AS before FROM o),
p AS (SELECT c, n, role, text, i, fault IN (1, 2) AS g, CAST(fault = 3 AS BIGINT) AS t FROM e),
m AS (SELECT DISTINCT c, conv_id FROM k),
st AS (SELECT c, CAST(0 AS BIGINT) AS n, '' AS q, CAST(0 AS BIGINT) AS cost, '' AS letters, CAST([] AS VARCHAR[]) AS lines FROM m
  UNION ALL
  SELECT c, n, q, cost, letters, lines FROM (SELECT *, row_number() OVER (PARTITION BY c, q ORDER BY cost, letters) AS r FROM (
    WITH x AS (SELECT st.c, p.n, st.q, st.cost, st.letters, st.lines, p.role, p.text, p.i, p.g, p.t FROM st JOIN p ON p.c = st.c AND p.n = st.n + 1)
    {" UNION ALL ".join(macros)})) WHERE r = 1),
z AS (SELECT c, CAST(cost AS BIGINT) + CASE q WHEN 's' THEN 4 WHEN 'u' THEN 2 ELSE 0 END AS cost, letters || CASE q WHEN 's' THEN 'II' WHEN 'u' THEN 'I' ELSE '' END AS letters,
        list_concat(lines, CASE q WHEN 's' THEN ['user:', 'assistant:'] WHEN 'u' THEN ['assistant:'] ELSE CAST([] AS VARCHAR[]) END) AS lines
      FROM st WHERE n = (SELECT coalesce(max(p.n), 0) FROM p WHERE p.c = st.c)),
b AS (SELECT *, row_number() OVER (PARTITION BY c ORDER BY cost, letters) AS r FROM z),
s AS (SELECT c, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 1) AS blank, count(*) FILTER (fault = 2) AS duplicate, count(*) FILTER (fault = 3) AS truncated,
        count(*) FILTER (n > 1 AND before || i NOT IN ('su', 'ua', 'au')) AS illegal FROM e GROUP BY c)
SELECT m.conv_id, coalesce(s.gaps, 0) AS gaps, coalesce(s.blank, 0) AS blank, coalesce(s.duplicate, 0) AS duplicate, coalesce(s.truncated, 0) AS truncated, coalesce(s.illegal, 0) AS illegal,
       b.cost, b.letters AS audit, sha256(coalesce(array_to_string(b.lines, chr(10)), '')) AS repaired_sha256 FROM m JOIN b ON b.c = m.c AND b.r = 1 LEFT JOIN s ON s.c = m.c
"""


@query(_op13_sql())
def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faults and cheapest repair of every conversation."""
    from weftmill.llm import conversations

    return conversations.report(conversations.damage(table(spark, sf_dir, "conversations")))
