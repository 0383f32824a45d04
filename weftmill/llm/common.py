"""What the training-data operators share: scratch tables in the shared folder, row hygiene, bounded caches.

Scratch tables go to ``spark.checkpoint.dir``, are written with Spark's commit protocol, and therefore survive the loss
of any executor. Where the setting is missing, a local session (as in tests) gets a temporary folder; a cluster gets an
error, since no machine's own folder is shared. A block ``with scratch_tables(spark) as made:`` owns the tables that its
thread makes within it, and ``made.drop(keep=...)`` deletes them; tables of other threads and callers stay.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftmill.session import ship_package

_FALLBACK: dict[str, str] = {}
_OWNERS: ContextVar[tuple] = ContextVar("owners", default=())


def scratch_root(spark: SparkSession) -> str:
    """The shared folder for intermediate tables."""
    ship_package(spark)
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        app = spark.sparkContext.applicationId
        root = _FALLBACK.get(app) or f"file://{tempfile.mkdtemp(prefix='weftmill-scratch-')}"
        _FALLBACK[app] = root
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


def scratch_path(spark: SparkSession, tag: str) -> str:
    """A fresh path below the shared folder."""
    path = f"{scratch_root(spark)}/weftmill/{uuid.uuid4().hex}-{tag}"
    for owner in _OWNERS.get():
        owner.paths.append(path)
    return path


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` as a scratch table and read it back: cuts the lineage at a table that all executors share."""
    spark = df.sparkSession
    path = scratch_path(spark, tag)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._weftmill_path = path
    return out


def drop(df_or_path: DataFrame | str, spark: SparkSession | None = None) -> None:
    """Delete a scratch table that nothing reads any more."""
    path = df_or_path if isinstance(df_or_path, str) else getattr(df_or_path, "_weftmill_path", None)
    spark = spark or df_or_path.sparkSession
    if path:
        hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
        hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)


class ScratchTables:
    """The scratch tables that one caller has made."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, []

    def drop(self, keep: str = "") -> None:
        """Delete them, save ``keep``; for callers that have written their result."""
        for path in self.paths:
            if path != keep:
                drop(path, self.spark)
        self.paths = [keep] if keep in self.paths else []


@contextmanager
def scratch_tables(spark: SparkSession) -> Iterator[ScratchTables]:
    """Own the scratch tables that this thread makes within the block; if the block fails, they go."""
    made = ScratchTables(spark)
    token = _OWNERS.set((*_OWNERS.get(), made))
    try:
        yield made
    except BaseException:
        made.drop()
        raise
    finally:
        _OWNERS.reset(token)


def texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the two columns that the operators read; any other column, whatever its name, stays out of the plan."""
    types = dict(docs.dtypes)

    def plain(name: str, kind: str, alias: str) -> F.Column:  # no alias where none is needed: equal plans stay equal
        return F.col(name) if (name, types.get(name)) == (alias, kind) else F.col(name).cast(kind).alias(alias)

    return docs.select(plain(id_col, "bigint", "doc_id"), plain(text_col, "string", "text"))


def arrow_schema(ddl: str) -> pa.Schema:
    """The Arrow schema of a DDL string."""
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(T._parse_datatype_string(ddl))


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that each has about ``most`` bytes of text (one row at least): bounds a worker's memory."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        block = np.cumsum(sizes.astype(np.int64)) // most
        edges = [0, *(np.flatnonzero(np.diff(block)) + 1).tolist(), batch.num_rows]
        for a, b in zip(edges, edges[1:], strict=False):
            yield batch.slice(a, b - a)


def per_text(df: DataFrame, fn: Callable[[pa.RecordBatch], dict], ddl: str, most: int = 4 << 20) -> DataFrame:
    """``mapInArrow`` with batches of bounded text size; ``fn`` returns columns by name in the order of ``ddl``."""
    schema = arrow_schema(ddl)
    names = schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, most=most):
            columns = fn(part)
            yield pa.RecordBatch.from_arrays([pa.array(columns[n], type=schema.field(n).type) if not isinstance(columns[n], (pa.Array, pa.ChunkedArray)) else columns[n].cast(schema.field(n).type) for n in names], schema=schema)

    return df.mapInArrow(run, ddl)


def bounded_sample(df: DataFrame, key: str, most: int) -> DataFrame:
    """At most about ``most`` rows, chosen by a hash of ``key``: the same rows in every run, from all parts of the table.

    The share is set from the row count, so the sample is spread over the whole table, and a final limit on the
    hash order holds the bound exactly. Only model fitting uses it; scores, counts and indexes cover all rows.
    """
    n = df.count()
    h = F.pmod(F.xxhash64(F.col(key).cast("string")), F.lit(1 << 30))
    if n > most:
        df = df.where(h < int((1 << 30) * most / n))
    return df.orderBy(h, key).limit(most)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit (the splitmix64 finaliser)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class TwoGenerations:
    """A cache of at most ``2 * most`` entries: when the young half is full it becomes the old one; hits move up."""

    def __init__(self, most: int = 200_000):
        self.most, self.young, self.old = most, {}, {}

    def get(self, key):
        value = self.young.get(key)
        if value is None and self.old:
            value = self.old.get(key)
            if value is not None:
                self.put(key, value)
        return value

    def put(self, key, value) -> None:
        if len(self.young) >= self.most:
            self.old, self.young = self.young, {}
        self.young[key] = value
