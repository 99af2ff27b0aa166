"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import tempfile
import uuid
from dataclasses import dataclass
from weakref import WeakKeyDictionary

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, DataType, MapType, StringType, StructType

#: Bytes of a side, as it stands in a join's hash table, up to which it is
#: broadcast; beyond, it is shuffled.
BROADCAST_BYTES = 64 << 20
#: Bits of a key filter at most (32 MB), and bits for each key below that.
FILTER_BITS = 1 << 28
BITS_A_KEY = 16
#: Rows in an Arrow batch at most: with whole texts in them, Spark's default of
#: 10,000 takes tens of megabytes on both sides of each worker's pipe.
BATCH_ROWS = 2000
#: Spark's setting that drops a query's shuffle files when it has ended.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Where stored tables are.
_PATHS: WeakKeyDictionary = WeakKeyDictionary()
#: Stands for a null id inside joins; orders before every other id.
NULL_ID = -(1 << 63)


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share; a temporary one only where none is
    set and everything runs on this machine (tests)."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not path:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="dagloom-")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(path)
    return path.rstrip("/")


def small_batches(spark: SparkSession) -> None:
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


def stored(df: DataFrame, name: str, **options: str) -> DataFrame:
    """The rows, written as a Parquet table in the shared folder and read again.

    Cuts the lineage so that a lost executor costs a reread, not a rerun.  What
    was shuffled for the table goes once it is written.
    """
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    small_batches(df.sparkSession)
    before = df.sparkSession.conf.get(CLEANUP)
    df.sparkSession.conf.set(CLEANUP, "true")
    try:
        df.write.options(**options).parquet(path)
    finally:
        df.sparkSession.conf.set(CLEANUP, before)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    _PATHS[out] = path
    return out


def drop(*tables: DataFrame) -> None:
    """Deletes stored tables that nothing which is still to run reads."""
    for df in tables:
        path = _PATHS.pop(df, None)
        if path:
            where = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(where, True)


def row_bytes(kinds: list[DataType]) -> int:
    """About what a row of numbers takes in a hash table of a broadcast join."""
    return 48 + 8 * len(kinds)


def _value_bytes(c: Column, kind: DataType) -> Column:
    """About what a value takes there, by its own length."""
    if isinstance(kind, (BinaryType, StringType)):
        return 24 + F.coalesce(F.octet_length(c), F.lit(0))
    if isinstance(kind, StructType):
        return sum((_value_bytes(c[f.name], f.dataType) for f in kind.fields), F.lit(16))
    if isinstance(kind, ArrayType):
        if not isinstance(kind.elementType, (ArrayType, BinaryType, MapType, StringType, StructType)):
            return 24 + 8 * F.coalesce(F.size(c), F.lit(0))
        return F.coalesce(F.aggregate(c, F.lit(24).cast("long"), lambda n, x: n + _value_bytes(x, kind.elementType)), F.lit(24))
    if isinstance(kind, MapType):
        return _value_bytes(F.map_keys(c), ArrayType(kind.keyType)) + _value_bytes(F.map_values(c), ArrayType(kind.valueType))
    return F.lit(8)


def side_bytes(df: DataFrame) -> int:
    """About what the rows take in a hash table of a broadcast join, nested
    values by their lengths."""
    total = F.sum(sum((_value_bytes(F.col(f"`{f.name}`"), f.dataType) for f in df.schema), F.lit(48)).cast("long"))
    return df.agg(F.coalesce(total, F.lit(0)).alias("n")).first()["n"]


def small_side(df: DataFrame, most: int = BROADCAST_BYTES) -> DataFrame:
    """Marks a stored side for broadcast if its rows, which are counted and then
    measured, are small; else leaves it to a shuffled join."""
    return F.broadcast(df) if df.count() * row_bytes([*df.schema]) <= most and side_bytes(df) <= most else df


@dataclass
class KeyFilter:
    """A Bloom filter of mixed 64-bit keys with two probes: the keys' high and
    low bits.  Its size is bounded, so an exact join follows it."""

    bits: np.ndarray
    log: int

    def may_hold(self, key: np.ndarray) -> np.ndarray:
        out = None
        for slot in (key >> np.uint64(64 - self.log), key & np.uint64((1 << self.log) - 1)):
            hit = self.bits.take((slot >> np.uint64(3)).astype(np.int64)) >> (slot & np.uint64(7)).astype(np.uint8) & 1
            out = hit if out is None else out & hit
        return out.astype(bool)


def key_filter(keys: DataFrame, column: str = "key") -> KeyFilter:
    """The filter of a stored column of keys, put together by the executors as
    bitmaps of 4 KB each."""
    log = min(FILTER_BITS.bit_length() - 1, max(15, (BITS_A_KEY * keys.count()).bit_length()))
    high = F.shiftrightunsigned(column, 64 - log)
    low = F.col(column).bitwiseAND((1 << log) - 1)
    slots = keys.select(F.explode(F.array(high, low)).alias("slot")).select((F.col("slot") + 1).alias("slot"))
    found = slots.groupBy(F.bitmap_bucket_number("slot").alias("b")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("slot")).alias("bits"))
    bits = np.zeros((1 << log) // 8, np.uint8)
    for r in found.toLocalIterator():
        bits[(r["b"] - 1) * 4096 : r["b"] * 4096] = np.frombuffer(r["bits"], np.uint8)
    return KeyFilter(bits, log)


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def id_key(c: str | Column) -> Column:
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(NULL_ID)).cast("long")


def digest(text: str | Column) -> Column:
    """16 bytes that tell texts apart; null texts are empty."""
    c = F.col(text) if isinstance(text, str) else text
    return F.unhex(F.substring(F.sha2(F.coalesce(c.cast("string"), F.lit("")), 256), 1, 32))


def keyed(docs: DataFrame, text: str, key: str) -> DataFrame:
    """(k, text, t): a number for the id, the text and its digest."""
    whole = F.coalesce(F.col(text).cast("string"), F.lit(""))
    return docs.select(id_key(key).alias("k"), whole.alias("text")).withColumn("t", digest("text"))


def keyed_rows(docs: DataFrame, text: str, key: str) -> DataFrame:
    """(row, k, t): whole rows as structs, so that no column's name matters."""
    return docs.select(F.struct("*").alias("row"), id_key(key).alias("k"), digest(text).alias("t"))


def without(docs: DataFrame, gone: DataFrame, text: str, key: str) -> DataFrame:
    """docs without the rows that the stored table gone(k, t) names."""
    return keyed_rows(docs, text, key).join(small_side(gone), ["k", "t"], "left_anti").select("row.*")


def components(edges: DataFrame, name: str) -> DataFrame:
    """Connected components of edges(a, b) as (id, component), component being
    the smallest id.  Min-label hooking with pointer jumping; each round is
    stored.  Vertices without an edge are not returned.
    """
    table = stored(
        edges.select("a", "b").union(edges.select("b", "a")).where("a <> b").distinct(), f"{name}-edges"
    )
    both = table.toDF("id", "other")
    last = label = stored(both.groupBy("id").agg(F.min(F.least("id", "other")).alias("component")), f"{name}-label")
    while True:
        near = (
            both.join(label.toDF("other", "o"), "other")
            .groupBy("id")
            .agg(F.min("o").alias("m"))
            .join(label, "id")
            .select("id", F.least("m", "component").alias("c1"), "component")
        )
        jump = near.join(label.toDF("c1", "c2"), "c1", "left").select(
            "id", F.coalesce("c2", "c1").alias("new"), "component"
        )
        jump = stored(jump, f"{name}-label")
        changed = not jump.where("new <> component").isEmpty()
        label = jump.select("id", F.col("new").alias("component"))
        drop(last)
        last = jump
        if not changed:
            drop(table)
            return label
