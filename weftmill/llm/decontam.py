"""Benchmark decontamination by a distributed positional inverted index.

The index is keyed by term and holds every word of the corpus, whatever benchmark is asked later. A batch of documents
(about 4 MiB of text) gives one row for each of its terms: ``term, batch, n_docs, positions``, where a position counts
words from the start of the batch and documents lie ``GAP`` apart; a further row a batch lists its documents. Rows are
exchanged by term and slot of batches, so that the postings of a very common word are spread over many tasks, sorted,
and stored as a scratch table that any number of benchmarks can be looked up in.

A window is ``width`` consecutive words of an item (an item of fewer words is one window). Lookup:

1. document frequencies of the benchmark's terms are summed over the index;
2. each window hangs on its rarest term. The batches that hold one are found from that term's postings, and only there
   the lists of the window's other terms are asked for, by term and batch;
3. the lists of a batch meet, and each window's are intersected from the rarest term on, each adjusted by its offset in
   the window: what is left are exact phrase matches. A proximity match of an item is one of its windows whose
   ``near_terms`` rarest terms all occur within ``slop`` words of an occurrence of the rarest one.

What is shipped to the tasks is bounded, in number and in bytes: items are cut into segments of up to ``SEGMENT`` windows (a
segment reaches ``width - 1`` words into the next one, so no window is lost), and segments are taken in groups of about
``most_words`` words and ``most_bytes`` bytes, one after another, each looked up in the same stored index and its matches
written before the next one is read. So a benchmark, or a single item, of any size gives the whole result; what a group broadcasts
(its terms, and at most ``width`` pairs of terms for each of its windows) has that bound as well. 50,000 words are some 60 MB of
objects in a worker and 10 MB of closure.

Words: A-Z lower-cased, ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+``. Defined edge cases: a null text has no words and is
clean; items that are null, have no words or no id are skipped; repeated items count once; repeated documents are
judged each; a very long text is a batch of its own and is indexed whole; an empty table of documents gives no rows and
an empty benchmark no matches; a digest over no item is that of the empty string; other columns are left alone.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftmill.llm.common import arrow_schema, materialize, slices, texts

#: A-Z to a-z; 0-9, a-z and every byte of a non-ASCII character stay; all else separates words.
WORD_BYTES = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
GAP = 64  # words between two documents of a batch, so that nothing matches across them
SEGMENT = 10_000
INDEX = "term binary, batch long, n_docs int, positions binary, doc_ids array<long>, n_words array<int>, keys array<binary>"
HITS = "row_id string, doc_id long, key binary, n_words long, spans array<int>, items array<string>, near array<string>"


def words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(WORD_BYTES).split()


class Windows:
    """The windows of a group of items, and their lookup order once document frequencies are known."""

    def __init__(self, items: list[tuple[str, list[bytes]]], width: int = 13):
        found: dict[tuple[bytes, ...], set[str]] = {}
        for item, ws in items:
            for a in range(max(1, len(ws) - width + 1)):
                found.setdefault(tuple(ws[a : a + width]), set()).add(item)
        self.windows = [(w, sorted(i)) for w, i in found.items()]
        self.vocabulary = sorted({t for w in found for t in w})

    def order(self, df: dict[bytes, int], near_terms: int = 4) -> Windows:
        """Sort the terms of each window from rare to common and hang the window on its rarest term; a window with a
        term that no document holds is left out."""
        self.by_anchor: dict[bytes, list[tuple[list[tuple[bytes, int]], list[bytes], int, list[str]]]] = {}
        for w, items in self.windows:
            if all(t in df for t in w):
                plan = sorted(((t, o) for o, t in enumerate(w)), key=lambda x: (df[x[0]], x[0], x[1]))
                rare = list(dict.fromkeys(t for t, _ in plan))[:near_terms]
                self.by_anchor.setdefault(plan[0][0], []).append((plan, rare, len(w), items))
        return self

    def wanted(self) -> list[tuple[bytes, bytes]]:
        """``(anchor, term)``: the lists to ask for where the anchor occurs."""
        return sorted({(a, t) for a, plans in self.by_anchor.items() for plan, *_ in plans for t, _ in plan})


class _Numbers(dict):
    def __missing__(self, word: bytes) -> int:
        value = self[word] = len(self)
        return value


def postings(texts_: list[str | None]) -> tuple[list[bytes], np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``(terms, ends, positions, n_docs, n_words)`` of a batch: term ``i`` has ``positions[ends[i - 1]:ends[i]]``."""
    numbers = _Numbers()
    ids = []
    for t in texts_:
        ws = words(t)
        ids.append(np.fromiter(map(numbers.__getitem__, ws), dtype=np.int32, count=len(ws)))
    n_words = np.array([len(i) for i in ids], dtype=np.int32)
    flat = np.concatenate(ids) if ids else np.zeros(0, dtype=np.int32)
    doc = np.repeat(np.arange(len(ids), dtype=np.int32), n_words)
    order = np.argsort(flat, kind="stable")
    place = (np.arange(len(flat)) + doc.astype(np.int64) * GAP)[order].astype(np.int32)
    count = np.bincount(flat, minlength=len(numbers))
    ends = np.cumsum(count)
    doc, term = doc[order], flat[order]
    fresh = np.ones(len(doc), dtype=bool)
    fresh[1:] = (doc[1:] != doc[:-1]) | (term[1:] != term[:-1])
    return list(numbers), ends, place, np.bincount(term[fresh], minlength=len(numbers)), n_words


def starts_of(n_words: np.ndarray) -> np.ndarray:
    """Where each document of a batch starts."""
    size = n_words.astype(np.int64) + GAP
    return np.cumsum(size) - size


def match(lists: dict[bytes, np.ndarray], windows: Windows, slop: int = 26) -> tuple[list[tuple[int, int, list[str]]], list[tuple[int, list[str]]]]:
    """Exact matches ``(start, size, items)`` and proximity matches ``(place, items)`` in the lists of one batch."""
    exact, close = [], []
    none = np.zeros(0, dtype=np.int64)
    for anchor in lists.keys() & windows.by_anchor.keys():
        here = lists[anchor]
        for plan, rare, size, items in windows.by_anchor[anchor]:
            starts = here - plan[0][1]
            for t, o in plan[1:]:
                if not len(starts):
                    break
                other = lists.get(t, none) - o  # the list of t, adjusted by its offset
                at = np.searchsorted(other, starts)
                starts = starts[other[np.minimum(at, len(other) - 1)] == starts] if len(other) else none
            exact += [(s, size, items) for s in starts.tolist()]
            around = here
            for t in rare[1:]:
                other = lists.get(t, none)
                if not len(other) or not len(around):
                    around = none
                    break
                k = np.searchsorted(other, around)
                gap = np.minimum(np.abs(other[np.minimum(k, len(other) - 1)] - around), np.abs(around - other[np.maximum(k - 1, 0)]))
                around = around[gap <= slop]
            close += [(p, items) for p in around.tolist()]
    return exact, close


def merged(spans: list[tuple[int, int]]) -> list[int]:
    """Overlapping and adjoining spans as one flat list of starts and ends."""
    out: list[int] = []
    for a, b in sorted(spans):
        if out and a <= out[-1]:
            out[-1] = max(out[-1], b)
        else:
            out += [a, b]
    return out


def row_key() -> F.Column:
    """What tells rows of documents apart: the digest of id and text."""
    return F.unhex(F.md5(F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.md5(F.coalesce("text", F.lit("")))))).alias("key")


def build_index(docs: DataFrame, slot_bytes: int = 1 << 30) -> DataFrame:
    """The stored index of all words of all documents; the postings of a term in a gigabyte of text meet in one task."""
    rows = texts(docs)
    total = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("n")).first()["n"]
    schema = arrow_schema(INDEX)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        for batch in slices(batches):
            terms, ends, place, n_docs, n_words = postings(batch.column("text").to_pylist())
            begin = ends - np.diff(ends, prepend=0)
            deltas = np.diff(place, prepend=0).astype("<i4")
            deltas[begin] = place[begin]
            offsets = np.append(0, ends * 4).astype(np.int32)
            n = len(terms)
            lists = pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(offsets), pa.py_buffer(deltas)])
            null = [pa.nulls(n, schema.field(c).type) for c in ("doc_ids", "n_words", "keys")]
            yield pa.RecordBatch.from_arrays([pa.array(terms, type=pa.binary()), pa.array(np.full(n, number)), pa.array(n_docs.astype(np.int32)), lists, *null], schema=schema)
            own = [pa.array([batch.column("doc_id").to_pylist()], type=schema.field("doc_ids").type), pa.array([n_words.tolist()], type=schema.field("n_words").type), pa.array([batch.column("key").to_pylist()], type=schema.field("keys").type)]
            yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.binary()), pa.array([number]), pa.nulls(1, pa.int32()), pa.nulls(1, pa.binary()), *own], schema=schema)
            number += 1

    slot = F.pmod(F.xxhash64("batch"), F.lit(max(1, -(-total // slot_bytes))))
    index = rows.select("doc_id", "text", row_key()).mapInArrow(run, INDEX)
    spread = F.when(F.col("term").isNull(), F.xxhash64("batch")).otherwise(F.xxhash64("term"))
    return materialize(index.repartition(spread, slot).sortWithinPartitions("term", "batch"), "postings")


def frequencies(index: DataFrame, vocabulary: DataFrame) -> dict[bytes, int]:
    """Document frequency of each term that occurs; the driver gets one number a benchmark term."""
    counted = index.where("term is not null").select("term", "n_docs").join(F.broadcast(vocabulary), "term", "left_semi").groupBy("term").agg(F.sum("n_docs").alias("n"))
    return {bytes(r["term"]): r["n"] for r in counted.collect()}


def lookup(index: DataFrame, windows: Windows, slop: int = 26) -> DataFrame:
    """The matches of every document of a stored index; ``windows`` is one group, whose size is checked."""
    if slop >= GAP:
        raise ValueError(f"slop must be below {GAP}")
    spark = index.sparkSession
    windows.order(frequencies(index, spark.createDataFrame([(t,) for t in windows.vocabulary], "term binary")))
    wanted = F.broadcast(spark.createDataFrame(windows.wanted(), "anchor binary, asked binary"))
    lists = index.where("term is not null").select("term", "batch", "positions")
    asked = lists.select("term", "batch").join(wanted, F.col("term") == F.col("anchor")).select(F.col("asked").alias("term"), "batch").distinct()
    found = lists.join(F.broadcast(spark.createDataFrame([(t,) for t in windows.vocabulary], "term binary")), "term", "left_semi").join(asked.hint("merge"), ["term", "batch"], "left_semi")
    batches = index.where("term is null").select(F.col("batch").alias("number"), "doc_ids", "n_words", "keys")
    found = found.select("term", F.col("batch").alias("number"), "positions")
    schema = arrow_schema(HITS)

    def run(docs: pa.Table, found: pa.Table) -> pa.Table:
        out: list[list] = [[] for _ in schema.names]
        if docs.num_rows:
            lists = {t: np.cumsum(np.frombuffer(p, "<i4"), dtype=np.int64) for t, p in zip(found.column("term").to_pylist(), found.column("positions").to_pylist(), strict=True)}
            n_words = np.array(docs.column("n_words")[0].as_py(), dtype=np.int64)
            begin = starts_of(n_words)
            exact, close = match(lists, windows, slop)
            spans: dict[int, list] = {}
            items: dict[int, set] = {}
            near: dict[int, set] = {}
            for (start, size, names), d in zip(exact, (np.searchsorted(begin, [e[0] for e in exact], side="right") - 1).tolist(), strict=True):
                spans.setdefault(d, []).append((start - int(begin[d]), start - int(begin[d]) + size))
                items.setdefault(d, set()).update(names)
            for (_, names), d in zip(close, (np.searchsorted(begin, [c[0] for c in close], side="right") - 1).tolist(), strict=True):
                near.setdefault(d, set()).update(names)
            number = docs.column("number")[0].as_py()
            for d, (doc_id, key) in enumerate(zip(docs.column("doc_ids")[0].as_py(), docs.column("keys")[0].as_py(), strict=True)):
                own = items.get(d, set())
                row = (f"{number}:{d}", doc_id, key, int(n_words[d]), merged(spans.get(d, [])), sorted(own), sorted(near.get(d, set()) - own))
                for column, v in zip(out, row, strict=True):
                    column.append(v)
        return pa.Table.from_arrays([pa.array(c, type=f.type) for c, f in zip(out, schema, strict=True)], schema=schema)

    return batches.groupBy("number").cogroup(found.groupBy("number")).applyInArrow(run, HITS)


def _items(benchmark: DataFrame) -> DataFrame:
    return benchmark.select(F.col("item_id").cast("string").alias("item"), F.col("text").cast("string").alias("text")).where("item is not null and text is not null").distinct()


def segments(benchmark: DataFrame, width: int = 13) -> DataFrame:
    """``item, body, n``: the words of each item, space-joined, in segments of up to ``SEGMENT`` windows."""
    ddl = "item string, body binary, n long"
    schema = arrow_schema(ddl)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            rows = []
            for item, text in zip(batch.column("item").to_pylist(), batch.column("text").to_pylist(), strict=True):
                ws = words(text)
                for a in range(0, max(1, len(ws) - width + 1), SEGMENT):
                    part = ws[a : a + SEGMENT + width - 1]
                    if part:
                        rows.append((item, b" ".join(part), len(part)))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], type=f.type) for i, f in enumerate(schema)], schema=schema)

    return _items(benchmark).mapInArrow(run, ddl)


def item_groups(benchmark: DataFrame, width: int = 13, most_words: int = 50_000, most_bytes: int = 2 << 20) -> Iterator[list[tuple[str, list[bytes]]]]:
    """The segments in groups of about ``most_words`` words and ``most_bytes`` bytes, read one after another: what is on
    the driver and is shipped to the tasks at one time has a checked size."""
    if most_words < 1 or most_bytes < 1:
        raise ValueError("a group holds at least one word")
    rows = segments(benchmark, width)
    total = rows.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum(F.octet_length("body")), F.lit(0)).alias("b")).first()
    groups = max(1, -(-total["n"] // most_words), -(-total["b"] // most_bytes))
    rows = materialize(rows, "segments") if groups > 1 else rows
    for g in range(groups):
        part = rows if groups == 1 else rows.where(F.pmod(F.xxhash64("item", "body"), F.lit(groups)) == g)
        yield [(r["item"], bytes(r["body"]).split()) for r in part.select("item", "body").collect()]


def matches(docs: DataFrame, benchmark: DataFrame, width: int = 13, slop: int = 26, most_words: int = 50_000, most_bytes: int = 2 << 20, index: DataFrame | None = None) -> DataFrame:
    """``HITS`` of every document, through ``index`` or a new one."""
    index = build_index(docs) if index is None else index
    parts, last = [], None
    for items in item_groups(benchmark, width, most_words, most_bytes):
        if last is not None:  # of all but the last group only documents with a match are kept
            parts.append(materialize(lookup(index, last, slop).where("size(spans) > 0 or size(near) > 0"), "matches"))
        last = Windows(items, width)
    part = lookup(index, last, slop)
    if not parts:
        return part
    for p in parts:
        part = part.unionByName(p)
    of = [F.first(c).alias(c) for c in ("doc_id", "key", "n_words")]
    grouped = part.groupBy("row_id").agg(*of, *[F.flatten(F.collect_list(c)).alias(c) for c in ("spans", "items", "near")])
    schema = arrow_schema(HITS)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = [merged(list(zip(s[::2], s[1::2], strict=True))) for s in batch.column("spans").to_pylist()]
            items = [sorted(set(x)) for x in batch.column("items").to_pylist()]
            near = [sorted(set(x) - set(y)) for x, y in zip(batch.column("near").to_pylist(), items, strict=True)]
            same = [batch.column(c) for c in ("row_id", "doc_id", "key", "n_words")]
            yield pa.RecordBatch.from_arrays([*same, *(pa.array(v, type=schema.field(c).type) for c, v in (("spans", spans), ("items", items), ("near", near)))], schema=schema)

    return grouped.mapInArrow(merge, HITS)


def contaminated(n_hit: F.Column, n_words: F.Column) -> F.Column:
    return (n_hit > 0) & (n_hit * 20 >= n_words)


def _n_hit() -> F.Column:
    return F.aggregate(F.transform("spans", lambda x, i: F.when(i % 2 == 1, x).otherwise(-x)), F.lit(0).cast("int"), lambda a, x: a + x).cast("long")


def report(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """``doc_id, n_words, n_hit, n_items, items_sha256, contaminated, n_near`` of every document."""
    rows = matches(docs, benchmark, **options).withColumn("n_hit", _n_hit())
    return rows.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("items_sha256"),
        contaminated(F.col("n_hit"), F.col("n_words")).alias("contaminated"), F.size("near").cast("long").alias("n_near"),
    )


def keep_clean(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` that aren't contaminated, with their columns."""
    bad = matches(docs, benchmark, **options).where(contaminated(_n_hit(), F.col("n_words"))).select(F.col("key").alias("_weftmill_bad")).distinct()
    marked = docs.withColumn("_weftmill_key", row_key())
    return marked.join(bad.hint("merge"), F.col("_weftmill_key") == F.col("_weftmill_bad"), "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])


def digest(items: list[str]) -> str:
    return hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()
