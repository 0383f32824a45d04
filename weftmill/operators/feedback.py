"""Questions and answers: feedback and manual additions that land on the most similar question.

Inputs count in order of ``n``. Each goes to the most similar pair at or above a threshold, among the stored pairs and those that
earlier inputs have made, or makes a new one. All inputs are compared with the stored pairs in one distributed pass. Only those that no
stored pair is similar to can make one, so only they are settled in order: ``SETTLED`` of them in a task, whose new pairs
then take out what is similar to them among the rest, in the tasks. A last pass compares all inputs with the pairs made before them. The driver
gets counts and the last ``n`` of a block, and memory is that of two groups of vectors however many inputs come.

Then one ordered fold for each pair gives its answer, sources and feedback, and moves of confidence are counted where the direction
of feedback changes. Scores are rounded to six places and ties go to the smaller id; a new pair's id is ``-n - 1``.

A null or zero vector, or one with a null component, is similar to nothing; null sources are none; blank or repeated sources count once; an empty input changes nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftmill.scratch import kept

PAIRS = "id long, question string, vector array<double>, answer string, sources array<string>, feedback string"
SIDE = 16_384
SETTLED = 16_384
STEP = 512


def _usable(v: Column) -> Column:
    held = F.coalesce(v, F.array().cast("array<double>"))
    return ~F.exists(held, lambda x: x.isNull()) & F.exists(held, lambda x: x != 0)


def _nearest(asked: DataFrame, corpus: DataFrame, threshold: float, digits: int = 6) -> DataFrame:
    """``n, id, score``: the row of ``corpus`` (id, born, vector) most similar to each of ``asked`` (n, vector), at or above ``threshold``.

    A row with a ``born`` counts only for inputs after it. Both sides are hashed into groups of about ``SIDE`` rows, and a task
    compares one group with one other, ``STEP`` inputs at a time; it gives a row for an input, so neither the driver nor a task holds a side.
    """
    sides = [max(1, -(-side.count() // SIDE)) for side in (asked, corpus)]
    step = STEP
    schema = pa.schema([("n", pa.int64()), ("id", pa.int64()), ("score", pa.float64())])

    def matrix(t: pa.Table) -> np.ndarray:
        v = t.column("vector").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(t.num_rows, -1)
        return v / np.linalg.norm(v, axis=1, keepdims=True)

    def compare(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return schema.empty_table()
        right = right.sort_by("id")  # the first of equal scores is the smaller id
        n, ids, born = left.column("n").to_numpy(), right.column("id").to_numpy(), right.column("born").fill_null(np.iinfo(np.int64).min).to_numpy()
        a, b, out = matrix(left), matrix(right).T, []
        for at in range(0, len(n), step):
            own = n[at : at + step]
            s = np.round(a[at : at + step] @ b, digits)
            s[~(s >= threshold) | (born[None, :] >= own[:, None])] = -np.inf
            best = s.argmax(axis=1)
            score = s[np.arange(len(own)), best]
            some = score > -np.inf
            out.append(pa.table([own[some], ids[best[some]], score[some]], schema=schema))
        return pa.concat_tables(out)

    every = lambda size: F.explode(F.sequence(F.lit(0), F.lit(size - 1)))
    part = lambda key, size: F.pmod(F.xxhash64(key), F.lit(size)).cast("int")
    left = asked.select("n", "vector", part("n", sides[0]).alias("q"), every(sides[1]).alias("c"))
    right = corpus.select("id", "born", "vector", every(sides[0]).alias("q"), part("id", sides[1]).alias("c"))
    found = left.groupBy("q", "c").cogroup(right.groupBy("q", "c")).applyInArrow(compare, "n long, id long, score double")
    return _best(found)


def _best(found: DataFrame) -> DataFrame:
    best = found.groupBy("n").agg(F.min(F.struct((-F.col("score")).alias("score"), "id")).alias("b"))
    return best.select("n", "b.id", (-F.col("b.score")).alias("score"))


def _settled(block: DataFrame, threshold: float, digits: int = 6) -> DataFrame:
    """Those rows of one block (n, vector) that no earlier one, itself left, is similar to."""
    schema, step = pa.schema([("n", pa.int64()), ("vector", pa.list_(pa.float64()))]), STEP

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        t = pa.Table.from_batches(held).sort_by("n")
        v = t.column("vector").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(t.num_rows, -1)
        v = v / np.linalg.norm(v, axis=1, keepdims=True)
        left = np.empty(0, dtype=np.int64)
        for at in range(0, len(v), step):
            own = v[at : at + step]
            alive = ~(np.round(own @ v[left].T, digits) >= threshold).any(axis=1) if len(left) else np.ones(len(own), dtype=bool)
            near = np.round(own @ own.T, digits) >= threshold
            for i in range(len(own)):
                if alive[i]:
                    alive[i + 1 :] &= ~near[i, i + 1 :]
            left = np.concatenate([left, at + np.flatnonzero(alive)])
        yield from t.take(pa.array(left)).select(["n", "vector"]).cast(schema).to_batches()

    return block.coalesce(1).mapInArrow(settle, "n long, vector array<double>")


def assign(pairs: DataFrame, inputs: DataFrame, threshold: float, always: Column | None = None) -> DataFrame:
    """``n, id, score, made``: the pair of each input (n, vector), and whether the input makes it.

    ``score`` is that of the similar pair, null if there is none; where ``always`` holds, the input makes a pair of its own all the same,
    and ``id`` is still the similar one.
    """
    asked = kept(inputs.select(F.col("n").cast("long"), F.col("vector").cast("array<double>").alias("vector"), F.coalesce(always if always is not None else F.lit(False), F.lit(False)).alias("always")), "asked")
    clean = asked.where(_usable(F.col("vector")))
    stored = pairs.where(_usable(F.col("vector"))).select(F.col("id").cast("long"), F.lit(None).cast("long").alias("born"), F.col("vector").cast("array<double>").alias("vector"))
    pair = lambda rows: rows.select((-F.col("n") - 1).alias("id"), F.col("n").alias("born"), "vector")
    old = kept(_nearest(clean.select("n", "vector"), stored, threshold), "stored")
    made = clean.where("always").select("n", "vector")
    open_ = kept(clean.where(~F.col("always")).select("n", "vector").join(old.select("n"), "n", "left_anti"), "open")
    open_ = kept(open_.join(_nearest(open_, pair(made), threshold).select("n"), "n", "left_anti"), "open")
    while True:
        block = kept(open_.orderBy("n").limit(SETTLED), "block")
        last = block.agg(F.max("n")).first()[0]
        if last is None:
            break
        fresh = kept(_settled(block, threshold), "made")
        made = made.unionByName(fresh)
        rest = open_.where(F.col("n") > last)
        open_ = kept(rest.join(_nearest(rest, pair(fresh), threshold).select("n"), "n", "left_anti"), "open")
    best = _best(old.unionByName(_nearest(clean.select("n", "vector"), pair(made), threshold)))
    rows = asked.select("n", "always").join(best, "n", "left")
    return kept(rows.select("n", F.coalesce("id", -F.col("n") - 1).alias("id"), "score", (F.col("always") | F.col("score").isNull()).alias("made")), "matched")


def _sources(lists: Column) -> Column:
    return F.array_distinct(F.filter(lists, lambda s: s.isNotNull() & (F.trim(s) != "")))


def folded(pairs: DataFrame, steps: DataFrame) -> DataFrame:
    """``pairs`` after ``steps`` (id, n, question, vector, answer, sources, feedback, how), in order of ``n``.

    ``how``: ``merge`` appends an answer unless it is the whole answer so far, joins the sources and takes the feedback; ``overwrite``
    replaces all three. The first step of a new pair is the pair.
    """
    none = F.array().cast("array<string>")
    step = F.struct("n", F.col("question").alias("q"), F.col("vector").alias("v"), F.coalesce("answer", F.lit("")).alias("answer"), F.coalesce("sources", none).alias("sources"), "feedback", "how")
    lists = steps.groupBy("id").agg(F.array_sort(F.collect_list(step)).alias("steps"))  # what becomes one row: a pair's own text
    rows = pairs.join(lists, "id", "full_outer")
    state = lambda a, s, f: F.struct(a.alias("answer"), s.alias("sources"), f.cast("string").alias("feedback"))
    start = F.when(F.col("question").isNotNull(), state(F.coalesce("answer", F.lit("")), _sources(F.coalesce("sources", none)), F.col("feedback")))

    def fold(acc: Column, x: Column) -> Column:
        fresh = state(x["answer"], _sources(x["sources"]), x["feedback"])
        answer = F.when(acc["answer"] == x["answer"], acc["answer"]).otherwise(F.concat(acc["answer"], F.lit("\n\n"), x["answer"]))
        return F.when(acc.isNull() | (x["how"] == "overwrite"), fresh).otherwise(state(answer, _sources(F.concat(acc["sources"], x["sources"])), x["feedback"]))

    end = F.aggregate(F.coalesce("steps", F.slice(F.array(F.lit(None).cast(lists.schema["steps"].dataType.elementType)), 1, 0)), start, fold)
    first = F.try_element_at("steps", F.lit(1))
    return rows.select("id", F.coalesce("question", first["q"]).alias("question"), F.coalesce("vector", first["v"]).alias("vector"), end.alias("e")).select("id", "question", "vector", "e.*")


def record(pairs: DataFrame, inputs: DataFrame, threshold: float = 0.9) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``(pairs, matches, moves)`` after feedback inputs (n, question, vector, answer, sources, feedback).

    ``moves``: ``path, feedback, moves``, how often each direction moves the confidence of a wiki page: only where it differs from the pair's
    feedback before.
    """
    matches = assign(pairs, inputs, threshold)
    steps = inputs.join(matches.select("n", "id"), "n").withColumn("how", F.lit("merge"))
    before = F.lag(F.struct("feedback")).over(Window.partitionBy("id").orderBy("n"))
    told = steps.join(pairs.select("id", F.struct("feedback").alias("stored")), "id", "left").withColumn("before", F.coalesce(before, "stored")["feedback"])
    moved = told.where(~F.col("before").eqNullSafe(F.col("feedback")) & F.col("feedback").isNotNull())
    moves = moved.select("feedback", F.explode(_sources(F.col("sources"))).alias("path")).where(F.col("path").startswith("wiki/")).groupBy("path", "feedback").agg(F.count("*").alias("moves"))
    return folded(pairs, steps.select("id", "n", "question", "vector", "answer", "sources", "feedback", "how")), matches, moves


def manual_add(pairs: DataFrame, inputs: DataFrame, threshold: float = 0.9) -> tuple[DataFrame, DataFrame]:
    """``(pairs, outcomes)`` after manual additions (n, question, vector, answer, sources, mode); outcomes: ``n, id, score, action``.

    Without a similar pair an input is inserted; else its mode says what happens (``merge``, ``overwrite``, ``add-anyway``), and without a mode
    a decision is needed and nothing is written.
    """
    matches = assign(pairs, inputs, threshold, F.col("mode") == "add-anyway")
    mode = F.col("mode")
    action = F.when(F.col("score").isNull(), "inserted").when(mode == "merge", "merged").when(mode == "overwrite", "overwritten").when(mode == "add-anyway", "added_anyway").otherwise("needs_decision")
    rows = inputs.join(matches, "n").withColumn("action", action)
    own = F.col("action").isin("inserted", "added_anyway")
    steps = rows.where("action <> 'needs_decision'").select(F.when(own, -F.col("n") - 1).otherwise(F.col("id")).alias("id"), "n", "question", "vector", "answer", "sources", F.lit(None).cast("string").alias("feedback"), F.when(F.col("action") == "overwritten", "overwrite").otherwise("merge").alias("how"))
    return folded(pairs, steps), rows.select("n", F.when(F.col("score").isNotNull(), F.col("id")).alias("id"), "score", "action")
