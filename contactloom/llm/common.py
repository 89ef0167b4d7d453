"""What the operators share: tables, scratch space, Column idioms."""

from __future__ import annotations

import ctypes
import gc
import os
import tempfile
import uuid
from collections.abc import Callable, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word of the contracts: a run of anything but the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"
#: Words of a shingle.
SHINGLE = 5
ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def on_workers(spark: SparkSession) -> None:
    """Lets Python workers started on this host import the library (a cluster gets it by --py-files)."""
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if ROOT not in paths:
        env["PYTHONPATH"] = os.pathsep.join([ROOT, *paths])


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder below spark.checkpoint.dir. Where that is unset, a temporary folder stands in on a local master only:
    executors of a cluster don't share it."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base}/{name}-{uuid.uuid4().hex}"


class Tables:
    """The tables that a job writes on its way, below one scratch folder. Each cuts the lineage: a lost executor costs the
    tasks since the last one. Those that nothing reads any more are dropped."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.base, self.made = spark, scratch(spark, name), 0

    def written(self, df: DataFrame, name: str, drop: Sequence[DataFrame] = (), codec: str = "snappy") -> DataFrame:
        """The rows, written and read again; then the tables `drop` that this made go."""
        self.made += 1
        path = f"{self.base}/{name}-{self.made}"
        df.write.option("compression", codec).parquet(path)
        for old in drop:
            self.drop(old)
        out = self.spark.read.schema(df.schema).parquet(path)
        out.scratch_path = path
        return out

    def drop(self, df: DataFrame) -> None:
        remove(self.spark, df.scratch_path)

    def clear(self) -> None:
        remove(self.spark, self.base)


def remove(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def released() -> None:
    """Gives memory that is free back to the system, where the C library can: a worker serves many tasks and a driver many
    jobs, and what one of them needed for a while isn't held against the next."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, each with underscores added until no column of df has it, whatever its case."""
    taken, out = {c.lower() for c in df.columns}, []
    for n in names:
        while n.lower() in taken:
            n += "_"
        taken.add(n.lower())
        out.append(n)
    return out


def beside(key: str, *names: str) -> list[str]:
    """The names of columns beside the key; the one that is the key's, whatever its case, with an underscore."""
    return [n + "_" * (n == key.lower()) for n in names]


#: A key with more than this part of all rows is hot; there are fewer such keys than this.
HOT = 4096


def met(rows: DataFrame, one: DataFrame, key: str, count: str, total: int) -> DataFrame:
    """rows joined with `one`, which has a row for each key and says how many of the `total` rows it has. Hot keys, fewer
    than HOT whatever the data, are broadcast, so that none of them is one task's work; the others meet by shuffle."""
    hot = F.col(count) * HOT > total
    loud, rest = F.broadcast(one.where(hot).drop(count)), one.where(~hot).drop(count)
    return rows.join(loud, key).unionByName(rows.join(loud.select(key), key, "left_anti").join(rest, key))


#: Rows of a few numbers that are broadcast at most.
BROADCAST_ROWS = 1 << 20


def small(df: DataFrame) -> DataFrame:
    """With a hint to broadcast where the rows, counted, are few; by shuffle beyond that."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with the value computed once a row, however often lambdas in the body use it."""
    return F.transform(F.array(value), body)[0]


def words(text: Column) -> Column:
    """The words of a text as an array, in order; none for null."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE), lambda w: w != "")


def shingle_hashes(text: Column, shingle: int = SHINGLE) -> Column:
    """A hash for each run of `shingle` words, repeats kept; one for all words where there are fewer."""

    def of(h: Column) -> Column:
        runs = F.transform(F.sequence(F.lit(0), F.size(h) - shingle), lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(shingle)]))
        return F.when(F.size(h) >= shingle, runs).when(F.size(h) > 0, F.array(F.xxhash64(h))).otherwise(F.array().cast("array<bigint>"))

    return let(F.transform(words(text), lambda w: F.xxhash64(w)), of)


def unit(hashed: Column) -> Column:
    """A double in (0, 1) from a 64-bit hash."""
    return (F.shiftrightunsigned(hashed, 12).cast("double") + 0.5) / F.lit(float(1 << 52))


def spread(rows: int, per_part: int, least: int = 1, most: int = 1 << 20) -> int:
    """A power of two of parts for so many rows."""
    want, parts = max(least, rows // max(1, per_part)), 1
    while parts < want and parts < most:
        parts *= 2
    return parts


def cut_points(df: DataFrame, key: str, rows_per_part: int, most_bits: int = 16) -> list[int]:
    """2^b - 1 ascending keys that part the rows about evenly; at most 2^16 - 1 numbers come to the driver."""
    parts = spread(df.count(), rows_per_part, 1, 1 << most_bits)
    if parts == 1:
        return []
    found = df.stat.approxQuantile(key, [i / parts for i in range(1, parts)], 1 / (4 * parts)) or [0.0] * (parts - 1)
    return sorted(int(x) for x in found)


def part_of(key: Column, cuts: list[int]) -> Column:
    """How many cut points are at or below the key, by binary search; 0 for null."""
    bits = len(cuts).bit_length()
    if not bits:
        return F.lit(0)
    table = F.lit(cuts).cast("array<bigint>")
    steps = F.lit([1 << (bits - 1 - i) for i in range(bits)])
    found = F.aggregate(steps, F.lit(0), lambda at, step: F.when(F.get(table, at + step - 1) <= key, at + step).otherwise(at))
    return F.when(key.isNull(), 0).otherwise(found)
