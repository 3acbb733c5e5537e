"""Helpers that several operators share: hashing folds, shared scratch tables, checked sizes."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ASCII_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
ASCII_LOWER = ASCII_UPPER.lower()

#: bytes.translate table that lower-cases A-Z only
LOWER_TABLE = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One parquet table of a data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(key: Column, modulus: int) -> Column:
    """crc32 of the key as text, modulo ``modulus`` (the held-out rule of the contracts)."""
    return F.crc32(key.cast("string").cast("binary")) % modulus


def ascii_lower(col: Column) -> Column:
    return F.translate(col, ASCII_UPPER, ASCII_LOWER)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; one is made only where none is named and all runs in one process."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if spark.sparkContext.master != "local" and not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="barloom-shared-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


class Scratch:
    """Tables written once in the shared folder: they cut lineage and outlive executors.

    ``put`` writes and rereads a table; ``drop`` deletes tables that no later plan reads.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/barloom/{name}-{uuid.uuid4().hex}"
        self.n = 0

    def put(self, df: DataFrame, name: str) -> DataFrame:
        self.n += 1
        path = f"{self.root}/{name}-{self.n}"
        df.write.option("compression", "zstd").parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._barloom_path = path
        return out

    def drop(self, df: DataFrame) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(df._barloom_path)
        fs = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        fs.delete(path, True)


#: parts that the rows of one key are dealt to in :func:`spread_join`
SPREAD = 64


def spread_join(rows: DataFrame, few: DataFrame, key: str, mark: Column, how: str = "inner") -> DataFrame:
    """``rows`` joined by ``key`` with ``few``, which has few rows per key; a key that many rows have goes to SPREAD tasks.

    ``mark`` is a hash of what tells rows of one key apart.  Each part that a key has in ``rows`` gets its own copy
    of the key's rows in ``few``, so no task meets all rows of a key.
    """
    dealt = rows.withColumn("__part", F.pmod(mark, F.lit(SPREAD)).cast("int"))
    copies = dealt.select(key, "__part").distinct().join(few, key)
    return dealt.join(copies, [key, "__part"], how).drop("__part")


#: rows of one key from which it is a hub, and hubs at most
HUB, HUBS = 1000, 50_000


def hub_join(rows: DataFrame, few: DataFrame, key: str, n: str, total: int, mark: Column) -> DataFrame:
    """``rows`` joined by ``key`` with ``few``, which has few rows per key and says in ``n`` how many the key has in ``rows``.

    Keys with more rows than HUB, and than one HUBS-th of the ``total`` rows, are hubs: of these there are HUBS at most,
    so their rows of ``few`` are broadcast, and their rows in ``rows`` are dealt to SPREAD parts by ``mark``.  All other
    keys are shuffled as in any join.
    """
    limit, values = max(HUB, total // HUBS), [c for c in few.columns if c not in (key, n)]
    hubs = few.where(F.col(n) > limit).select(key, F.struct(*values).alias("__hub"))
    others = few.where(F.col(n) <= limit).select(key, F.lit(0).alias("__part"), F.struct(*values).alias("__other"))
    told = rows.join(F.broadcast(hubs), key, "left").withColumn("__part", F.when(F.col("__hub").isNull(), 0).otherwise(1 + F.pmod(mark, F.lit(SPREAD)).cast("int")))
    found = F.coalesce("__hub", "__other")
    both = told.join(others, [key, "__part"], "left").where(found.isNotNull())
    return both.select(*rows.columns, *[found[c].alias(c) for c in values])


def slices(batches, rows: int = 1000):
    """Arrow batches cut into parts of at most ``rows`` rows, which bounds what a task holds besides its input."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


_WHITE = re.compile(rb"[\x20\x09-\x0D]")


def pieces(text: bytes, size: int = 1 << 20):
    """A text cut at white space into parts of about ``size`` bytes, so that only one part's words are held as a list."""
    at = 0
    while len(text) - at > size:
        cut = _WHITE.search(text, at + size)
        if cut is None:
            break
        yield text[at : cut.start()]
        at = cut.start()
    yield text[at:] if at else text


def text_bytes(column) -> list:
    """An Arrow string column as a list of UTF-8 byte strings; null is empty."""
    import pyarrow as pa

    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]
