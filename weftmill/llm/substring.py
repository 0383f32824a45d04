"""Substring dedup by recompression: repeats of ``width`` words found through symbols that equal passages share.

Naming. The words of a document are symbols. A round replaces each run of an equal symbol by one symbol, then each pair
of a "left" symbol followed by a "right" one by one symbol (a bit of its name says which side a symbol is on, so pairs
don't overlap). A name is a 64-bit digest of what it stands for, so every task names alike and no dictionary is sent
around. Each symbol carries its dependency extent: the words that decide that it stands there. Equal windows therefore
hold the same symbols wherever the extent lies within the window; only symbols at the borders may differ.

Spark rounds, one for each level of symbols. In round ``r`` each window that is still alive chooses, of the symbols of
level ``r`` that it determines, the one with the smallest mixed name, which stands for the words of its extent. A window
that determines none stands for itself in the first round and waits in the later ones. The chosen names are grouped over the whole corpus, and a name that stands in
one document only ends every window that chose it: it can't repeat elsewhere. The names that are left go back to the
buckets they came from, and only their windows climb to the next level.

Verify: the windows alive after the last round give two independent 64-bit digests of their words; all occurrences of a
window meet, and the smallest doc_id of each is known. Cut: windows that start in a smaller doc_id cover the words that
go; both digests (128 bits) are compared there.

How the rows move. Documents are dealt to buckets of about ``bucket_bytes`` by a hash of id and text, and the texts are
exchanged once, compressed, by bucket. What is known of a name or a window goes to buckets, not to documents: a passage that a third
of all documents share is one row a bucket when it is grouped, whatever the number of documents. Exact copies of a text
cost no more than their share of a map-side minimum: the (id, digest) of each text's first document is sent to that
document's own bucket, every row that finds no such note is a copy, and nothing is joined on the text's digest. Wholly equal rows,
id and text, are one row with a number, and as many again at the end.

Words: ``[^\\x20\\x09-\\x0D]+``, unchanged. Defined edge cases: a null text has no words; a document without an id loses
nothing and is no one's source; rows with equal doc_id are one document to each other (nothing is removed for their
sake) and are cut each; a very long text is one row of its bucket and is processed whole; an empty table gives no rows;
other columns are left alone.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftmill.llm.common import arrow_schema, mix, per_text, slices, texts

_C = np.uint64(0x9E3779B97F4A7C15)
_P, _Q = np.uint64(0x9FB21C651E98DF25), np.uint64(0xD6E8FEB86659FD93)
NOTE = "bucket int, kind int, a long, b long, c long, key binary"


_GAP = np.isin(np.arange(256), np.frombuffer(b" \t\n\r\x0b\x0c", dtype=np.uint8))
_LONG = 64  # bytes: longer words are named by a library digest
_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * _C)
_POWER = np.cumprod(np.full(_LONG, _Q))


def symbols(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Names of the words of all texts, each text followed by one zero, and the number of words of each."""
    raw = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    joined = b"\n".join(raw)
    data = np.frombuffer(joined, dtype=np.uint8)
    gap = _GAP[data]
    edge = np.flatnonzero(np.diff(gap.view(np.int8), prepend=1, append=1))
    start, size = edge[::2], edge[1::2] - edge[::2]
    ends = np.cumsum(np.fromiter(map(len, raw), dtype=np.int64, count=len(raw)) + 1)
    count = np.diff(np.searchsorted(start, ends), prepend=0)
    out = np.zeros(len(start) + len(raw), dtype=np.uint64)
    if len(start):
        body = data[~gap]
        first = np.cumsum(size) - size
        place = np.minimum(np.arange(len(body)) - np.repeat(first, size), _LONG - 1)
        name = mix(np.add.reduceat(_BYTE[body] * _POWER[place], first) + size.astype(np.uint64) * _C)
        for i in np.flatnonzero(size > _LONG).tolist():
            name[i] = xxhash.xxh64_intdigest(joined[start[i] : start[i] + size[i]])
        out[np.arange(len(start)) + np.repeat(np.arange(len(raw)), count)] = name
    return out, count


def recompress(s: np.ndarray, rounds: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(name, first, after)``: names after the rounds and their dependency extents ``[first, after)`` in words."""
    name, first, after = s, np.arange(len(s)), np.arange(1, len(s) + 1)
    for r in range(rounds):
        # runs
        start = np.flatnonzero(np.concatenate([[True], name[1:] != name[:-1]]))
        size = np.diff(np.append(start, len(name)))
        left = np.where(start > 0, first[start - 1], -1)
        stop = np.append(start[1:], len(name))
        right = np.where(stop < len(name), after[np.minimum(stop, len(name) - 1)], len(s) + 1)
        runs = name[start]
        name = np.where(size > 1, mix(runs ^ mix(size.astype(np.uint64) + _C)), runs)
        first, after = left, right
        # pairs
        side = mix(name + np.uint64(2 * r + 1)) & np.uint64(1)
        second = np.concatenate([[False], (side[:-1] == 0) & (side[1:] == 1)])
        head = np.flatnonzero(~second)
        tail = np.minimum(head + 1, len(name) - 1)
        paired = second[tail] & (head + 1 < len(name))
        last = np.where(paired, tail, head)
        left = np.where(head > 0, first[head - 1], -1)
        right = np.where(last + 1 < len(name), after[np.minimum(last + 1, len(name) - 1)], len(s) + 1)
        name = np.where(paired, mix(name[head] * _P + mix(name[tail] + _Q)), name[head])
        first, after = left, right
    return name, first, after


def window_digests(s: np.ndarray, at: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Two independent 64-bit digests of the windows that start at ``at``."""
    other = mix(s + _C)
    h, g = np.zeros(len(at), dtype=np.uint64), np.zeros(len(at), dtype=np.uint64)
    for k in range(width):
        h = h * _P + s[at + k]
        g = g * _Q + other[at + k]
    return mix(h), mix(g)


def spans_digest(s: np.ndarray, first: np.ndarray, after: np.ndarray) -> np.ndarray:
    """Digests of the words ``[first, after)``, from one running sum (powers of an odd number have inverses)."""
    with np.errstate(over="ignore"):
        power = np.cumprod(np.full(len(s), _P))
        back = np.cumprod(np.full(len(s), np.uint64(pow(int(_P), -1, 1 << 64))))
        total = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(s * power)])
        return mix((total[after] - total[first]) * back[first] ^ mix((after - first).astype(np.uint64)))


def choices(s: np.ndarray, at: np.ndarray, width: int, rounds: int) -> np.ndarray:
    """The names of :func:`choose`."""
    return choose(s, at, width, rounds)[0]


def choose(s: np.ndarray, at: np.ndarray, width: int, rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """What each window starting at ``at`` (ascending) chooses: a function of the window's words alone.

    The window takes, of the symbols that it determines, the one with the smallest mixed name. The symbol stands for
    its whole dependency extent, whose words are all in the window: common words alone don't bring documents together.
    Also whether it determines any symbol; one that doesn't takes its own words.
    """
    name, first, after = recompress(s, rounds)
    rank = mix(name + _C)
    low = np.cumsum(np.bincount(first + 1, minlength=len(s) + 1))[at]  # symbols whose extent starts before the window
    high = np.cumsum(np.bincount(after, minlength=len(s) + 2))[at + width]  # and those whose extent ends by its end
    some = high > low
    out = np.zeros(len(at), dtype=np.uint64)
    out[~some] = window_digests(s, at[~some], width)[0] ^ _C
    low, high = low[some], high[some]
    if len(low):
        best, table, step = np.zeros(len(low), dtype=np.int64), np.arange(len(rank)), 1
        size = high - low
        while True:
            mine = (size >= step) & (size < 2 * step)
            a, b = table[low[mine]], table[high[mine] - step]
            best[mine] = np.where(rank[a] <= rank[b], a, b)
            if not (size >= 2 * step).any():
                break
            a, b = table[: len(table) - step], table[step:]
            table = np.where(rank[a] <= rank[b], a, b)
            step *= 2
        used, where = np.unique(best, return_inverse=True)
        out[some] = spans_digest(s, first[used], after[used])[where]
    return out, some


def _starts(lengths: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Window starts in texts joined with one separator after each document, and the document of each."""
    base = np.concatenate([[0], np.cumsum(lengths + 1)])[:-1]
    count = np.maximum(lengths - width + 1, 0)
    doc = np.repeat(np.arange(len(lengths)), count)
    return np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + base[doc], doc


def _gathered(key: list[np.ndarray], doc_id: np.ndarray) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """One row for each key of a bucket: the keys, the smallest doc_id, and whether there are several doc_ids."""
    order = np.argsort(key[0])
    for first, other in zip(key, key[1:], strict=False):  # equal first digests of different windows: sort by both
        if ((first[order][1:] == first[order][:-1]) & (other[order][1:] != other[order][:-1])).any():
            order = np.lexsort(key[::-1])
    key, doc_id = [k[order] for k in key], doc_id[order]
    start = np.zeros(len(doc_id), dtype=bool)
    start[:1] = True
    for k in key:
        start[1:] |= k[1:] != k[:-1]
    begin = np.flatnonzero(start)
    if not len(begin):
        return key, doc_id, start
    low = np.minimum.reduceat(doc_id, begin)
    return [k[begin] for k in key], low, low != np.maximum.reduceat(doc_id, begin)


def _turns(name: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Where a new name or document starts: neighbouring windows mostly choose the same symbol."""
    turn = np.ones(len(name), dtype=bool)
    turn[1:] = (name[1:] != name[:-1]) | (doc[1:] != doc[:-1])
    return turn


_UNPACK = zstandard.ZstdDecompressor()
PACKED = "doc_id long, body binary, key binary, n long"


def packed(docs: DataFrame) -> DataFrame:
    """Texts compressed for the exchange, which four rounds read."""
    schema = arrow_schema(PACKED)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=1).compress
        for batch in slices(batches):
            body = [None if t is None else pack(t.encode("utf-8")) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(body, type=pa.binary()), batch.column("key"), batch.column("n")], schema=schema)

    return docs.mapInArrow(run, PACKED)


class _Bucket:
    """The texts of one bucket and what has been noted about them."""

    def __init__(self, docs: pa.Table, notes: pa.Table):
        self.ids = docs.column("doc_id").to_numpy()
        self.texts = [None if b is None else _UNPACK.decompress(b).decode("utf-8") for b in docs.column("body").to_pylist()]
        self.keys, self.copies = docs.column("key").to_pylist(), docs.column("n").to_pylist()
        self.number = docs.column("bucket")[0].as_py() if docs.num_rows else 0
        kind = notes.column("kind").to_numpy()
        self.values = {k: [notes.column(c).to_numpy()[kind == k].view(np.uint64) for c in "abc"] for k in np.unique(kind).tolist()}
        mine = np.flatnonzero(kind == 0)
        ids, keys = notes.column("a").to_numpy(), notes.column("key")
        self.firsts = {(int(ids[i]), keys[int(i)].as_py()) for i in mine}

    def fresh(self) -> list[int]:
        """The rows that are the first of their text, one for each."""
        return list({p: i for i, p in reversed(list(enumerate(zip(self.ids.tolist(), self.keys, strict=True)))) if p in self.firsts}.values())

    def alive(self, width: int, level: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Symbols of the fresh texts, and the starts and doc_ids of the windows that the rounds up to ``level`` have left."""
        rows = self.fresh()
        joined, lengths = symbols([self.texts[i] for i in rows])
        at, doc = _starts(lengths, width)
        for r in range(1, level + 1):
            if not len(at):
                break
            name, some = choose(joined, at, width, r)
            turn = _turns(name, doc)
            kept = np.isin(name[turn], self.values[r][0] if r in self.values else joined[:0])[np.cumsum(turn) - 1]
            kept |= ~some & (r > 1)  # what a higher level can't judge stays as the level below left it
            at, doc = at[kept], doc[kept]
        return joined, at, self.ids[rows][doc] if len(at) else np.zeros(0, dtype=np.int64)


def _places(number: int, several: np.ndarray) -> pa.Array:
    """Where a row comes from: twice the bucket, and one more if several documents there have it."""
    return pa.array((2 * number + several).astype(np.int32))


def reveal(met: Callable, notes: DataFrame, width: int, level: int) -> DataFrame:
    """Notes (kind ``level``) of the level's chosen names that stand in more than one document."""
    schema = arrow_schema("name long, place int")

    def run(docs: pa.Table, known: pa.Table) -> pa.Table:
        bucket = _Bucket(docs, known)
        joined, at, ids = bucket.alive(width, level - 1)
        name, some = choose(joined, at, width, level) if len(at) else (np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=bool))
        turn = _turns(name, ids) & (some | (level == 1))
        (name,), _, several = _gathered([name[turn]], ids[turn])
        return pa.Table.from_arrays([pa.array(name.view(np.int64)), _places(bucket.number, several)], schema=schema)

    whole = Window.partitionBy("name")  # streamed and spilled, never one row: a name may stand in every bucket
    every = met(notes, run, "name long, place int")
    shared = every.select("name", "place", F.min("place").over(whole).alias("low"), F.max("place").over(whole).alias("high")).where("low <> high OR place % 2 = 1")
    return shared.select(F.expr("place div 2").cast("int").alias("bucket"), F.lit(level).alias("kind"), F.col("name").alias("a"), F.lit(0).cast("long").alias("b"), F.lit(0).cast("long").alias("c"), F.lit(None).cast("binary").alias("key"))


def verify(met: Callable, notes: DataFrame, width: int, rounds: int) -> DataFrame:
    """Notes (kind -1) of the windows that start in several documents: both digests and the smallest doc_id."""
    ddl = "h long, g long, low long, place int"
    schema = arrow_schema(ddl)

    def run(docs: pa.Table, known: pa.Table) -> pa.Table:
        bucket = _Bucket(docs, known)
        joined, at, ids = bucket.alive(width, rounds)
        (h, g), low, several = _gathered(list(window_digests(joined, at, width)), ids)
        return pa.Table.from_arrays([pa.array(h.view(np.int64)), pa.array(g.view(np.int64)), pa.array(low), _places(bucket.number, several)], schema=schema)

    told = met(notes, run, ddl).withColumn("least", F.min("low").over(Window.partitionBy("h", "g"))).where("low > least OR place % 2 = 1")
    return told.select(F.expr("place div 2").cast("int").alias("bucket"), F.lit(-1).alias("kind"), F.col("h").alias("a"), F.col("g").alias("b"), F.col("least").alias("c"), F.lit(None).cast("binary").alias("key"))


class _Gone:
    """The windows that other documents start with: ``(h, g) -> smallest doc_id``."""

    def __init__(self, h: np.ndarray, g: np.ndarray, least: np.ndarray):
        order = np.lexsort((g, h))
        self.h, self.g, self.least = h[order], g[order], least[order].view(np.int64)
        size = np.diff(np.flatnonzero(np.concatenate([[True], self.h[1:] != self.h[:-1], [True]]))) if len(h) else np.zeros(1)
        self.most = int(size.max())

    def hits(self, h: np.ndarray, g: np.ndarray, doc_id: np.ndarray) -> np.ndarray:
        """Which windows (by digests and own doc_id) start in a smaller doc_id."""
        out = np.zeros(len(h), dtype=bool)
        if len(self.h):
            at = np.searchsorted(self.h, h)
            for k in range(self.most):  # more than one only where the first digests of two windows are equal
                i = np.minimum(at + k, len(self.h) - 1)
                out |= (self.h[i] == h) & (self.g[i] == g) & (self.least[i] < doc_id)
        return out


def kept_words(bucket: _Bucket, width: int) -> list[tuple[list[bytes], int]]:
    """Of every text of a bucket the words that stay, and how many go."""
    gone = _Gone(*bucket.values[-1]) if -1 in bucket.values else _Gone(*[np.zeros(0, dtype=np.uint64)] * 3)
    of_first = np.array([p in bucket.firsts for p in zip(bucket.ids.tolist(), bucket.keys, strict=True)], dtype=bool)
    rows = np.flatnonzero(of_first)
    joined, lengths = symbols([bucket.texts[i] for i in rows.tolist()])
    at, doc = _starts(lengths, width)
    hit = gone.hits(*window_digests(joined, at, width), bucket.ids[rows][doc]) if len(at) and len(gone.h) else np.zeros(len(at), dtype=bool)
    cover = np.zeros(len(joined) + width + 1, dtype=np.int32)
    np.add.at(cover, at[hit], 1)
    np.add.at(cover, at[hit] + width, -1)
    keep = np.cumsum(cover)[: len(joined)] == 0
    base = dict(zip(rows.tolist(), (np.cumsum(lengths + 1) - lengths - 1).tolist(), strict=True))
    out = []
    for i, text in enumerate(bucket.texts):
        words = (text or "").encode("utf-8", "surrogatepass").split()
        if i not in base:  # a copy: all its windows start in the first document of its text
            out.append(([], len(words)) if len(words) >= width else (words, 0))
            continue
        mine = keep[base[i] : base[i] + len(words)]
        removed = len(words) - int(mine.sum())
        out.append(([w for w, k in zip(words, mine.tolist(), strict=True) if k] if removed else words, removed))
    return out


def single(rows: DataFrame) -> DataFrame:
    """Rows (doc_id, text, key) with ``n``: of wholly equal rows one, with their number.

    Ids and digests are counted first; only where some repeat, their rows are told apart by a join with the list of those.
    """
    repeated = rows.groupBy("doc_id", "key").agg(F.count("*").alias("n")).where("n > 1")
    if repeated.isEmpty():
        return rows.withColumn("n", F.lit(1).cast("long"))
    others = rows.join(repeated.select("doc_id", "key"), ["doc_id", "key"], "left_anti").select("doc_id", "text", "key", F.lit(1).cast("long").alias("n"))
    same = rows.join(repeated.select("doc_id", "key"), ["doc_id", "key"], "left_semi").groupBy("doc_id", "key").agg(F.first("text").alias("text"), F.count("*").alias("n"))
    return others.unionByName(same)


_ROWS = 1 << 10


def _copies(rows: DataFrame) -> DataFrame:
    """Rows with ``n`` as ``n`` rows each, in two steps, so that no array is long."""
    blocks = rows.withColumn("_block", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / _ROWS))))
    inside = F.least(F.lit(_ROWS).cast("long"), F.col("n") - F.col("_block") * _ROWS)
    return blocks.withColumn("_row", F.explode(F.sequence(F.lit(1).cast("long"), inside))).drop("n", "_block", "_row")


def _processed(docs: DataFrame, emit: Callable[[list[bytes], int], tuple], ddl: str, width: int, rounds: int, bucket_bytes: int) -> DataFrame:
    """``doc_id`` and what ``emit`` makes of the kept words and the number of removed ones, for every row."""
    every = texts(docs)
    total = every.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("n")).first()["n"]
    tasks = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    buckets = max(-(-total // bucket_bytes), 4 * tasks)  # several a task, so that tasks are even
    of = F.pmod(F.xxhash64("doc_id", "key"), F.lit(buckets)).cast("int").alias("bucket")
    key = F.unhex(F.md5(F.coalesce("text", F.lit("")))).alias("key")
    named = every.where("doc_id is not null")
    place = packed(single(named.select("doc_id", "text", key)).select("doc_id", "text", "key", "n")).select(of, "doc_id", "body", "key", "n").groupBy("bucket")
    none = F.lit(0).cast("long")
    first = named.select("doc_id", key).groupBy("key").agg(F.min("doc_id").alias("doc_id"))
    notes = first.select(of, F.lit(0).alias("kind"), F.col("doc_id").alias("a"), none.alias("b"), none.alias("c"), "key")

    def met(known: DataFrame, fn: Callable, schema: str) -> DataFrame:
        return place.cogroup(known.groupBy("bucket")).applyInArrow(fn, schema)

    known = notes
    for level in range(1, rounds + 1):
        known = known.unionByName(reveal(met, known, width, level))
    notes = notes.unionByName(verify(met, known, width, rounds))
    schema, counted = arrow_schema(ddl), arrow_schema(f"{ddl}, n long")

    def final(docs: pa.Table, known: pa.Table) -> pa.Table:
        bucket = _Bucket(docs, known)
        rows = [(doc_id, *emit(*k), n) for doc_id, k, n in zip(bucket.ids.tolist(), kept_words(bucket, width), bucket.copies, strict=True)]
        columns = zip(*rows, strict=True) if rows else [[] for _ in counted.names]
        return pa.Table.from_arrays([pa.array(c, type=f.type) for c, f in zip(columns, counted, strict=True)], schema=counted)

    def whole(batch) -> dict:
        out = [emit((t or "").encode("utf-8", "surrogatepass").split(), 0) for t in batch.column("text").to_pylist()]
        return {"doc_id": batch.column("doc_id"), **dict(zip(schema.names[1:], map(list, zip(*out, strict=True)), strict=True))}

    return _copies(met(notes, final, f"{ddl}, n long")).unionByName(per_text(every.where("doc_id is null"), whole, ddl))


def deduplicate(docs: DataFrame, width: int = 13, rounds: int = 2, bucket_bytes: int = 8 << 20) -> DataFrame:
    """``doc_id, text`` of every row, without the words that repeat an earlier document (kept words joined by a space)."""
    return _processed(docs, lambda kept, removed: (b" ".join(kept).decode("utf-8", "surrogatepass"),), "doc_id long, text string", width, rounds, bucket_bytes)


def report(docs: DataFrame, width: int = 13, rounds: int = 2, bucket_bytes: int = 8 << 20) -> DataFrame:
    """``doc_id, n_words, n_removed, kept_sha256`` of every row."""
    return _processed(docs, lambda kept, removed: (len(kept) + removed, removed, hashlib.sha256(b" ".join(kept)).hexdigest()), "doc_id long, n_words long, n_removed long, kept_sha256 string", width, rounds, bucket_bytes)
