"""Mixing sources to target weights by weighted fair queueing.

Each source gets a share of all words by weight; a share stops at ``most`` times what the source has, and what is over
is shared again by weight until no share is above. Every document of a source, in one shuffled order, which is read
again from its start in a later pass, gets a virtual finish time: the source's words up to its end, over the source's target.
All documents are then sorted by finish time across the table, and the order is cut at the budget, which is the number of
words of the table: all sources reach their targets together at time 1, so none is behind by more than a document. Only
documents that begin before time 1 queue; together they always fill the budget. The last one is cut to the word.

Running sums are taken over range partitions: rows are dealt by the whole order, each task adds up its sorted share, and the
shares' totals (a row each) give the offsets. A source, or an id, that holds a third of the table is therefore cut into
ranges like everything else. Wholly equal rows (id, source and size) are one item with a count and queue in groups of up to
32, which are single rows again at the end. Texts are read once; what is exchanged and stored is their sizes. Sources are a table as well:
their shares come from one aggregate for each time that something is shared again.

Defined edge cases: a null or empty text has no words, is in the result and takes none; a null source is a source, the
last; null ids are ids; equal ids are told apart by size, and equal rows share what they take, the first ones first; a source
without words has the target 0; an empty table gives no rows; other columns stay out. The order depends on ids
and ``seed`` alone, so that reruns agree.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from weftmill.llm.common import materialize, scratch_root

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (1, 2, 3)
_GROUP, _BLOCK = 32, 1 << 20
_WIDE = "decimal(38,0)"


def running(df: DataFrame, order: list[Column], values: list[str], tag: str, share: int = 500_000) -> DataFrame:
    """``df`` with ``<value>_upto``, the sum of each value (longs, none negative) up to and with the row in ``order``.

    The table is written in range partitions of about ``share`` rows; only their totals meet in one task.
    """
    ordered = df.repartitionByRange(max(1, -(-df.count() // share)), *order).sortWithinPartitions(*order)
    out = T.StructType([*df.schema, T.StructField("_share", T.IntegerType()), *(T.StructField(f"{v}_upto", T.LongType()) for v in values)])
    schema = to_arrow_schema(out)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, totals = TaskContext.get().partitionId(), [0] * len(values)
        for batch in batches:
            if batch.num_rows:
                sums = [t + np.cumsum(batch.column(v).to_numpy()) for t, v in zip(totals, values, strict=True)]
                totals = [int(s[-1]) for s in sums]
                yield pa.RecordBatch.from_arrays([*(c.cast(f.type) for c, f in zip(batch.columns, schema, strict=False)), pa.array(np.full(batch.num_rows, own, np.int32)), *map(pa.array, sums)], schema=schema)

    kept = materialize(ordered.mapInArrow(add, out), tag)
    ends = kept.groupBy("_share").agg(*(F.max(f"{v}_upto").alias(v) for v in values))
    before = Window.orderBy("_share").rowsBetween(Window.unboundedPreceding, -1)
    offsets = ends.select("_share", *(F.coalesce(F.sum(v).over(before), F.lit(0)).alias(f"_{v}") for v in values))
    joined = kept.join(F.broadcast(offsets), "_share")  # a row for each range partition
    return joined.select(*df.columns, *((F.col(f"{v}_upto") + F.col(f"_{v}")).alias(f"{v}_upto") for v in values))


def by_source() -> list[Column]:
    return [F.col("source").isNull(), F.col("source")]


def targets(items: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = 3) -> DataFrame:
    """``source, source_size, base, target`` of each source; base is the number of words of all sources before it."""
    sizes = items.groupBy("source").agg(F.sum("words").alias("source_size")).withColumn("one", F.lit(1).cast("bigint"))
    numbered = running(sizes, by_source(), ["one", "source_size"], "mix-sources")
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.col("one_upto") - 1, F.lit(len(weights))) + 1).cast("int")).cast("bigint")
    shares = numbered.select("source", "source_size", (F.col("source_size_upto") - F.col("source_size")).alias("base"), weight.alias("weight"), (F.col("source_size") * most).alias("cap"))
    total = shares.agg(F.coalesce(F.sum("source_size"), F.lit(0)).alias("n"), F.coalesce(F.sum("weight"), F.lit(0)).alias("w")).first()
    words, left, over = total.n, total.n, total.w

    def above(left: int, over: int) -> Column:
        return F.col("weight").cast(_WIDE) * F.lit(left).cast(_WIDE) > F.col("cap").cast(_WIDE) * F.lit(over).cast(_WIDE)

    while True:
        is_above = above(left, over)
        again = shares.agg(F.coalesce(F.sum(F.when(is_above, F.col("cap"))), F.lit(0)).alias("capped"), F.coalesce(F.sum(F.when(~is_above, F.col("weight"))), F.lit(0)).alias("w")).first()
        if again.w == over:
            break
        left, over = words - again.capped, again.w
    target = F.when(above(left, over), F.col("cap").cast("double")).otherwise((F.col("weight") * F.lit(left)).cast("double") / F.lit(float(over or 1)))
    return shares.select("source", "source_size", "base", target.alias("target"))


def groups(items: DataFrame) -> DataFrame:
    """A row for each 32 equal rows: ``first``, the number of copies before them, and ``copies``."""
    blocks = items.withColumn("_block", F.explode(F.sequence(F.lit(0), F.floor((F.col("n") - 1) / _BLOCK))))
    inside = F.least(F.lit(_BLOCK), F.col("n") - F.col("_block") * _BLOCK)
    at = blocks.withColumn("_at", F.explode(F.sequence(F.lit(0), F.floor((inside - 1) / _GROUP))))
    first = F.col("_block") * _BLOCK + F.col("_at") * _GROUP
    return at.withColumn("first", first).withColumn("copies", F.least(F.lit(_GROUP), F.col("n") - F.col("first"))).drop("_block", "_at", "n")


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = 3, seed: str = "mix") -> DataFrame:
    """``doc_id, size, source_size, target, taken`` of every document."""
    scratch_root(docs.sparkSession)
    size = F.regexp_count(F.coalesce(F.col("text").cast("string"), F.lit("")), F.lit(WORD)).cast("bigint")
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("source").cast("string").alias("source"), size.alias("size"))
    items = rows.groupBy("doc_id", "source", "size").agg(F.count("*").alias("n")).withColumn("words", F.col("size") * F.col("n"))
    place = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))))
    items = materialize(items.withColumn("place", F.conv(F.substring(place, 1, 15), 16, 10).cast("bigint")), "mix-items")
    sources = targets(items, weights, most)
    sources = materialize(sources, "mix-targets")
    budget = sources.agg(F.coalesce(F.sum("source_size"), F.lit(0)).alias("n")).first()["n"]
    named = sources.withColumnRenamed("source", "of")
    shuffled = running(items.where("size > 0"), [*by_source(), F.col("place"), F.col("doc_id"), F.col("size")], ["words"], "mix-shuffled").withColumnRenamed("words_upto", "item")

    grouped = groups(shuffled.join(named, F.col("source").eqNullSafe(F.col("of"))))
    begin = F.col("item") - F.col("words") - F.col("base") + F.col("first") * F.col("size")
    passes = F.sequence(F.lit(0), F.ceil(F.col("target") / F.col("source_size")).cast("int") - 1)
    queue = grouped.select("item", "first", "place", "source", "doc_id", "size", "target", "source_size", begin.alias("begin"), (F.col("copies") * F.col("size")).alias("queued"), F.explode(passes).alias("pass"))
    queue = queue.withColumn("begin", F.col("begin") + F.col("pass") * F.col("source_size")).where(F.col("begin") < F.col("target"))
    queue = queue.select("item", "first", "place", "source", "doc_id", "size", "pass", "queued", ((F.col("begin") + F.col("queued")).cast("double") / F.col("target")).alias("finish"))
    served = running(queue, [F.col("finish"), F.col("place"), *by_source(), F.col("doc_id"), F.col("size"), F.col("first"), F.col("pass")], ["queued"], "mix-queue")
    taken = F.greatest(F.lit(0), F.least(F.col("queued"), F.lit(budget) - F.col("queued_upto") + F.col("queued")))
    by_group = served.withColumn("taken", taken).where("taken > 0").groupBy("item", "first").agg(F.sum((F.col("taken") == F.col("queued")).cast("bigint")).alias("whole"), F.sum(F.when(F.col("taken") < F.col("queued"), F.col("taken"))).alias("rest"))

    found = grouped.select("item", "first", "copies", "doc_id", "size", "source_size", "target").join(by_group, ["item", "first"], "left")
    empty = groups(items.where("size = 0").join(named, F.col("source").eqNullSafe(F.col("of")))).select(F.lit(0).cast("bigint").alias("item"), "first", "copies", "doc_id", "size", "source_size", "target", F.lit(0).cast("bigint").alias("whole"), F.lit(0).cast("bigint").alias("rest"))
    single = found.unionByName(empty).withColumn("copy", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("copies").cast("bigint") - 1)))
    cut = F.greatest(F.lit(0), F.least(F.col("size"), F.coalesce(F.col("rest"), F.lit(0)) - F.col("copy") * F.col("size")))
    return single.select("doc_id", "size", "source_size", "target", (F.coalesce(F.col("whole"), F.lit(0)) * F.col("size") + cut).alias("taken"))
