"""Helpers shared by the operators of this folder: counted broadcasts, words and shingles, Python over texts."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.session import bound_batches, discard  # noqa: F401
from docloom.session import materialize as stage

#: Words are runs of anything but space and U+0009..U+000D (JVM and DuckDB regex dialects agree on it).
WORD = r"[^\x20\x09-\x0D]+"
#: A side is broadcast only if its measured rows times its row width stay below this.
BROADCAST_BYTES = 32 << 20
#: Arrow bytes that a Python function gets as objects at a time.
SLICE_BYTES = 4 << 20


def small(df: DataFrame, row_bytes: int) -> DataFrame:
    """df marked for broadcast if its counted rows fit BROADCAST_BYTES, else df as it is (a shuffled join)."""
    return F.broadcast(df) if df.count() * row_bytes <= BROADCAST_BYTES else df


def local_table(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A few rows of the driver (structs as dicts) as a DataFrame. createDataFrame() of a list passes them through Python
    workers on the executors, which stay there beside those of the next steps; Arrow doesn't."""
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    kind = _parse_datatype_string(schema)
    fields = to_arrow_schema(kind)
    columns = list(zip(*rows, strict=True)) or [()] * len(fields)
    return spark.createDataFrame(pa.table([pa.array(c, f.type) for c, f in zip(columns, fields, strict=True)], schema=fields), kind)


def release(spark: SparkSession) -> None:
    """Have the executors collect their garbage, a task for every core: heaps that earlier steps have grown shrink, and
    the memory goes back to the system before the next step's Python workers need theirs."""
    n = spark.sparkContext.defaultParallelism
    collected = spark.range(0, n, 1, n).select(F.java_method(F.lit("java.lang.System"), F.lit("gc")))
    collected.toDF("done").write.format("noop").mode("overwrite").save()


#: Rows of one key that a join leaves in one part.
HOT_ROWS = 500


def join_hot(many: DataFrame, one: DataFrame, key: str, how: str = "inner", hot: DataFrame | None = None) -> DataFrame:
    """many joined with one (a row per key) by key. Keys of more than HOT_ROWS rows are dealt to so many parts that each
    has about HOT_ROWS, and their row of one is repeated for every part. many should be a written table, since its keys
    are counted; hot (key, count) saves that.
    """
    counted = many.groupBy(key).count() if hot is None else hot
    hot = stage(counted.where(F.col("count") > HOT_ROWS).select(key, F.ceil(F.col("count") / HOT_ROWS).cast("int").alias("__parts")), "hot")
    n = hot.count()
    if not n:
        return many.join(one, key, how)
    hot = F.broadcast(hot) if n * 48 <= BROADCAST_BYTES else hot
    parts = F.coalesce("__parts", F.lit(1))
    part = F.pmod(F.xxhash64(*many.columns), parts).cast("int")
    dealt = many.join(hot, key, "left").withColumn("__part", part).drop("__parts")
    repeated = one.join(hot, key, "left").withColumn("__part", F.explode(F.sequence(F.lit(0), parts - 1))).drop("__parts")
    return dealt.join(repeated, [key, "__part"], how).drop("__part")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def words_of(text: str | None, lower: bool = False) -> list[bytes]:
    """Words of a text as UTF-8, with A-Z lower-cased if asked; bytes.split() splits at exactly U+0020 and U+0009..U+000D."""
    raw = text.encode("utf-8", "surrogatepass") if text else b""
    return (raw.lower() if lower else raw).split()


# 64-bit polynomial hashes of byte ranges: prefix sums of T[byte] * P^position, moved to position 0 by P^-start.
_P = np.uint64(0x9E3779B97F4A7C15)
_P_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_T = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_powers = {"p": np.ones(1, np.uint64), "q": np.ones(1, np.uint64)}


def _power(kind: str, base: np.uint64, n: int) -> np.ndarray:
    have = _powers[kind]
    if len(have) < n:
        size = 1 << (n - 1).bit_length()
        have = np.full(size, base, np.uint64)
        have[0] = 1
        have = np.multiply.accumulate(have)
        if size <= 1 << 20:  # those of longer texts aren't kept
            _powers[kind] = have
    return have


def mix64(x: np.ndarray) -> np.ndarray:
    """The public MurmurHash3 64-bit finaliser, vectorised."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def shingle_hashes(words: list[bytes], k: int) -> np.ndarray:
    """64-bit hash of every k-word shingle in order; fewer than k words make one shingle, none make none."""
    if not words:
        return np.empty(0, np.uint64)
    joined = b" ".join(words)
    raw = np.frombuffer(joined, np.uint8)
    n = len(raw)
    sums = np.empty(n + 1, np.uint64)
    sums[0] = 0
    np.cumsum(_T[raw] * _power("p", _P, n + 1)[:n], out=sums[1:])
    spaces = np.flatnonzero(raw == 32)
    starts = np.concatenate(([0], spaces + 1))
    ends = np.concatenate((spaces, [n]))
    if len(starts) > k:
        starts, ends = starts[: len(starts) - k + 1], ends[k - 1 :]
    else:
        starts, ends = starts[:1], ends[-1:]
    return mix64((sums[ends] - sums[starts]) * _power("q", _P_INVERSE, n + 1)[starts])


def map_texts(rows: DataFrame, fn, fields: str, keep: bool = False, done=None) -> DataFrame:
    """rows' columns, the last of which holds texts and goes unless kept, beside what fn makes of each batch of texts.

    fn takes a list of str or None and returns one list per field. Arrow batches keep ids exact, nulls included; where
    the session doesn't set their size, bound_batches() does, so that long texts don't add up. done is called at a
    task's end; then the worker, which lives on, gives back what it has freed.
    """
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType, _parse_datatype_string

    bound_batches(rows.sparkSession)
    last = len(rows.columns) - 1
    kept = rows.schema.fields if keep else rows.schema.fields[:-1]
    schema = StructType([*kept, *_parse_datatype_string(fields).fields])
    arrow = to_arrow_schema(schema)
    n = len(kept)

    def batches(it):
        for whole in it:
            # Python objects of a few MB at a time, whatever the size of Spark's batches
            step = max(1, SLICE_BYTES * whole.num_rows // max(whole.nbytes, 1))
            for at in range(0, max(whole.num_rows, 1), step):
                batch = whole.slice(at, step)
                made = fn(batch.column(last).to_pylist())
                arrays = [batch.column(i).cast(arrow.field(i).type) for i in range(n)]
                arrays += [v if isinstance(v, pa.Array) else pa.array(v, arrow.field(n + i).type) for i, v in enumerate(made)]
                yield pa.RecordBatch.from_arrays(arrays, schema=arrow)
                del batch, made, arrays
        if done:
            done()
        give_back()

    return rows.mapInArrow(batches, schema)


def give_back() -> None:
    """Return freed memory to the system where the C library can."""
    import ctypes
    import gc

    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)
