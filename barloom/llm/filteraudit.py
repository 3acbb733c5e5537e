"""How an ordered set of document filters interacts: what each removes, alone, after others, and in every order.

Every document becomes a mask of the filters that it fails.  Masks are counted into cells (part, mask), at most 32 for a
part, and the cells are unpivoted against the steps of all 120 orders.  A running bit-or over a cell's earlier steps says
whether an earlier filter has removed it; conditional sums give the counts of each step, and a window total per part and
filter gives the sum over all orders.

Filters: A fewer than 50 words; B 100 * distinct words < 65 * words; C 100 * [A-Z] > 5 * code points; D any of #$%&*|;
E the text of a smaller doc_id, anywhere in the table.  Words are maximal runs without ASCII white space.

Null text counts as empty (fails A, and E if a smaller id is empty too); null parts count as the empty string.  A row with a
null doc_id has no smaller one and is none.  Rows that repeat doc_id and text don't fail E by one another.  Labels that
repeat a doc_id count if any of them says 1; labels of a null doc_id count for nothing.  An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import re
from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import pieces, slices, text_bytes

LETTERS = "ABCDE"
MIN_WORDS, MIN_DISTINCT, MAX_CAPITALS = 50, 65, 5

_CAPITALS, _INNER, _ODD = bytes(range(65, 91)), bytes(range(0x80, 0xC0)), re.compile(rb"[#$%&*|]")


def text_mask(text: bytes) -> int:
    """The filters A to D that a UTF-8 text fails, as bits 1, 2, 4 and 8."""
    n_words, words = 0, set()
    for piece in pieces(text):
        found = piece.split()  # bytes split at the six ASCII white spaces
        n_words += len(found)
        words.update(found)
    points = len(text.translate(None, _INNER))
    capitals = len(text) - len(text.translate(None, _CAPITALS))
    return (
        (n_words < MIN_WORDS)
        | (100 * len(words) < MIN_DISTINCT * n_words) << 1
        | (100 * capitals > MAX_CAPITALS * points) << 2
        | (_ODD.search(text) is not None) << 3
    )


def _masked(batches):
    import pyarrow as pa

    for batch in batches:
        for rows in slices([batch], 256):
            texts = text_bytes(rows.column("text"))
            marks = pa.array([text_mask(t) for t in texts], pa.int32())
            digests = pa.array([hashlib.sha256(t).digest() for t in texts], pa.binary())
            yield pa.RecordBatch.from_arrays([rows.column("doc_id"), rows.column("part"), marks, digests], ["doc_id", "part", "mask", "digest"])


def document_marks(docs: DataFrame, part: str) -> DataFrame:
    """(doc_id, part, mask, digest) of every row; the mask says which of A to D the whole text fails."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text"), F.coalesce(F.col(part), F.lit("")).alias("part"))
    return rows.mapInArrow(_masked, "doc_id long, part string, mask int, digest binary")


def mask_cells(marks: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, mask, n, good, toxic): documents of each part by the filters A to E that they fail.

    Labels meet the marks by doc_id.  E needs no join back: of each text and kind of row the rows are counted together with
    those that have the smallest id, and the smallest id of a text is a window over these few counts.
    """
    flag = lambda name: F.coalesce(F.max(F.col(name) == 1), F.lit(False)).alias(name)
    told = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(flag("quality"), flag("toxic"))
    #: rows without id are dealt by their text, as one null key would be one task
    dealt = marks.withColumn("deal", F.when(F.col("doc_id").isNull(), F.xxhash64("digest")).otherwise(0))
    rows = dealt.join(told.withColumn("deal", F.lit(0).cast("long")), ["deal", "doc_id"], "left")
    rows = rows.select("deal", "doc_id", "digest", "part", "mask", F.coalesce("quality", F.lit(False)).alias("good"), F.coalesce("toxic", F.lit(False)).alias("toxic"))
    kind = ["digest", "part", "mask", "good", "toxic"]
    by_id = rows.groupBy("deal", "doc_id", *kind).agg(F.count(F.lit(1)).alias("n"))
    of_text = by_id.groupBy(*kind).agg(
        F.sum("n").alias("n"),
        F.coalesce(F.sum(F.when(F.col("doc_id").isNull(), F.col("n"))), F.lit(0)).alias("no_id"),
        F.min("doc_id").alias("first"),
        F.min_by("n", "doc_id").alias("n_first"),
    )
    leads = F.col("first").isNotNull() & (F.col("first") == F.min("first").over(Window.partitionBy("digest")))
    split = of_text.withColumn("unique", F.col("no_id") + F.when(leads, F.col("n_first")).otherwise(0))
    both = F.explode(F.array(F.struct(F.col("mask"), F.col("unique").alias("n")), F.struct((F.col("mask") + 16).alias("mask"), (F.col("n") - F.col("unique")).alias("n"))))
    cells = split.select("part", "good", "toxic", both.alias("cell")).where("cell.n > 0")
    return cells.groupBy("part", "cell.mask").agg(
        F.sum("cell.n").alias("n"),
        F.sum(F.when(F.col("good"), F.col("cell.n")).otherwise(0)).alias("good"),
        F.sum(F.when(F.col("toxic"), F.col("cell.n")).otherwise(0)).alias("toxic"),
    )


def _steps() -> Column:
    orders = F.array(*[F.lit("".join(p)) for p in permutations(LETTERS)])
    return F.transform(orders, lambda order: F.transform(F.sequence(F.lit(1), F.lit(5)), lambda step: F.struct(order.alias("filter_order"), step.alias("step"))))


def interactions(cells: DataFrame) -> DataFrame:
    """One row per part, order of the five filters and step, with the counts of the step's filter."""
    long = cells.withColumn("at", F.explode(F.flatten(_steps()))).select("*", "at.filter_order", "at.step").drop("at")
    long = long.withColumn("filter", F.substring("filter_order", F.col("step"), F.lit(1)))
    long = long.withColumn("bit", F.expr("shiftleft(1, ascii(filter) - ascii('A'))"))
    fails = F.col("mask").bitwiseAND(F.col("bit"))
    before = Window.partitionBy("part", "mask", "filter_order").orderBy("step").rowsBetween(Window.unboundedPreceding, -1)
    long = long.withColumn("fails", fails != 0).withColumn("earlier", F.coalesce(F.bit_or(fails).over(before), F.lit(0)) != 0)
    total = lambda when, of="n": F.sum(F.when(when, F.col(of)).otherwise(0)).cast("long")
    here = F.col("fails") & ~F.col("earlier")
    metrics = long.groupBy("part", "filter_order", "step", "filter").agg(
        total(~F.col("fails") & ~F.col("earlier")).alias("kept"),
        total(here).alias("removed"),
        total(F.col("fails") & F.col("earlier")).alias("redundant"),
        total(F.col("mask") == F.col("bit")).alias("unique_fails"),
        total(here, "good").alias("good_lost"),
        total(here, "toxic").alias("toxic_lost"),
    )
    return metrics.withColumn("shapley", F.sum("removed").over(Window.partitionBy("part", "filter"))).drop("filter")


def audit(docs: DataFrame, labels: DataFrame, part: str = "source") -> DataFrame:
    """The interactions of the filters over all of ``docs``, by the values of column ``part``."""
    return interactions(mask_cells(document_marks(docs, part), labels))
