"""Exact deduplication against a persistent index of text digests.

The index is a table of one row per digest, bucketed and sorted by the digest, that grows by loads.  A load is reduced to
its digests by a partial aggregate and laid out in the same buckets; a sort-merge anti-join, bucket to bucket and without a
shuffle, finds the digests that no earlier load brought, and these are appended.  Of equal texts the row with the largest
doc_id of the first load that holds the text stays.

Null text counts as empty, and all empty texts are equal.  A null doc_id is smaller than any other; a text that only rows
without id hold keeps the null id, and all of them.  Rows that repeat both doc_id and text are one document: they count in
the size of the group and are kept or dropped together.  An empty table adds nothing and gives no rows.  Only ``doc_id``
and ``text`` are read, so other columns may have any name.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, ascii_lower, hub_join, shared_dir

#: digests that one bucket is meant to hold
BUCKET_ROWS = 2_000_000

INDEX_COLUMNS = "digest BINARY, keep_id BIGINT, n BIGINT, load STRING"


def normalised(text: Column) -> Column:
    """Text with A-Z in lower case, null as empty; texts of ASCII alone take the fast way."""
    text = F.coalesce(text, F.lit(""))
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(ascii_lower(text))


def digest_of(text: Column) -> Column:
    return F.unhex(F.sha2(normalised(text).cast("binary"), 256))


def digests(docs: DataFrame) -> DataFrame:
    """(doc_id, digest) of every row: the SHA-256 of the normalised text in UTF-8."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), digest_of(F.col("text")).alias("digest"))


class DigestIndex:
    """A digest index in a folder that all executors share.

    ``digests`` holds (digest, keep_id, n, load) once per digest, ``repeats`` the number of rows that later loads had of a
    known digest.  Both are bucketed and sorted by digest.  The folder outlives the session: ``open`` finds the number of
    buckets in it.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int):
        self.spark, self.path, self.buckets = spark, path.rstrip("/"), buckets
        mark = hashlib.md5(self.path.encode()).hexdigest()
        self.names = {part: f"barloom_{part}_{mark}" for part in ("digests", "repeats")}
        for part in self.names:
            self._table(part, self.names[part])

    def _table(self, part: str, name: str) -> None:
        self.spark.sql(
            f"CREATE TABLE IF NOT EXISTS {name} ({INDEX_COLUMNS}) USING parquet OPTIONS (compression 'zstd') "
            f"CLUSTERED BY (digest) SORTED BY (digest) INTO {self.buckets} BUCKETS LOCATION '{self.path}/{part}'"
        )

    @classmethod
    def create(cls, spark: SparkSession, path: str, rows: int) -> DigestIndex:
        """A new index for about ``rows`` digests."""
        buckets = max(8, -(-rows // BUCKET_ROWS))
        spark.createDataFrame([(buckets,)], "buckets int").coalesce(1).write.json(f"{path.rstrip('/')}/about")
        return cls(spark, path, buckets)

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> DigestIndex:
        return cls(spark, path, spark.read.schema("buckets int").json(f"{path.rstrip('/')}/about").first()["buckets"])

    def rows(self, part: str = "digests") -> DataFrame:
        return self.spark.table(self.names[part])

    def add(self, marks: DataFrame, load: str) -> None:
        """Append the digests of ``marks`` (doc_id, digest) that no earlier load has.

        A load that broke off is repeated under its name: what it has appended by then is left as it is.
        """
        staged = f"barloom_load_{hashlib.md5(f'{self.path} {load}'.encode()).hexdigest()}"
        folder = f"{shared_dir(self.spark)}/barloom/{staged}"
        self.spark.sql(f"DROP TABLE IF EXISTS {staged}")
        _delete(self.spark, folder)
        groups = marks.groupBy("digest").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("n"))
        laid = groups.withColumn("load", F.lit(load)).repartition(self.buckets, "digest")
        laid.write.format("parquet").option("path", folder).bucketBy(self.buckets, "digest").sortBy("digest").saveAsTable(staged)
        earlier = self.rows().where(F.col("load") != load).select("digest").hint("merge")
        for part, how in (("digests", "left_anti"), ("repeats", "left_semi")):
            if self.rows(part).where(F.col("load") == load).isEmpty():
                found = self.spark.table(staged).join(earlier, "digest", how)
                found.select(*self.rows(part).columns).write.insertInto(self.names[part])
        self.spark.sql(f"DROP TABLE {staged}")
        _delete(self.spark, folder)

    def groups(self) -> DataFrame:
        """(digest, keep_id, group_size) of every digest, over all loads."""
        more = self.rows("repeats").groupBy("digest").agg(F.sum("n").alias("more")).hint("merge")
        all_rows = F.col("n") + F.coalesce("more", F.lit(0))
        return self.rows().join(more, "digest", "left").select("digest", "keep_id", all_rows.alias("group_size"))

    def judge(self, marks: DataFrame, total: int) -> DataFrame:
        """Every row of ``marks`` with keep_id, group_size and kept; ``total`` is the number of its rows.

        The rows of a text that very many rows share are dealt to many tasks.
        """
        few = self.groups().withColumn("__n", F.col("group_size"))
        told = hub_join(marks, few, "digest", "__n", total, F.xxhash64("doc_id"))
        return told.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("keep_id")))

    def forget(self) -> None:
        """Delete the index."""
        for name in self.names.values():
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        _delete(self.spark, self.path)


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def judge_documents(docs: DataFrame) -> DataFrame:
    """doc_id, keep_id, group_size, kept and text_sha256 of every row of one table, through an index of its own.

    The texts are read once, for their digests.  The upper half of the ids is loaded first, so that the row which stays is
    in the index before its copies with smaller ids are held against it.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "exact")
    marks = scratch.put(digests(docs), "marks")
    total, low, high = marks.agg(F.count(F.lit(1)), F.min("doc_id"), F.max("doc_id")).first()
    index = DigestIndex.create(spark, f"{scratch.root}/index", total)
    upper = F.coalesce(F.col("doc_id") > F.lit(None if low is None else (low + high) // 2), F.lit(False))
    index.add(marks.where(upper), "upper ids")
    index.add(marks.where(~upper), "lower ids")
    out = scratch.put(index.judge(marks, total).select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256")), "judged")
    index.forget()
    scratch.drop(marks)
    return out


def drop_copies(docs: DataFrame, index: DigestIndex, load: str) -> DataFrame:
    """The rows of ``docs`` whose text no earlier load and no row with a larger doc_id has; the load is added to ``index``.

    Of rows that repeat doc_id and text one stays.  All columns pass through, whatever their names.
    """
    marks = digests(docs)
    index.add(marks, load)
    first = index.rows().where(F.col("load") == load).select("digest", "keep_id")
    rows = docs.select(F.struct(*docs.columns).alias("row")).select("row", F.col("row.doc_id").cast("long").alias("doc_id"), digest_of(F.col("row.text")).alias("digest"))
    kept = rows.join(first, (rows["digest"] == first["digest"]) & rows["doc_id"].eqNullSafe(first["keep_id"]), "left_semi")
    return kept.dropDuplicates(["digest"]).select("row.*")
