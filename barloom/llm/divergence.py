"""How the vocabulary of each source of a language differs from the other sources and from the language.

Tasks count terms of their documents in DuckDB and hand (lang, source, term, count, documents) to shards, which are hashes
of (lang, term), so that all that is known of a term meets in one shard.  A shard's SQL sums the counts, keeps the terms of
at least ``min_docs`` documents of the language, and, once the totals are known, adds up partial pair sums and picks its
highest terms; Spark merges sums and rankings.

With c the count of a term in a group (lang, source), N the sum over kept terms and V their number,
p = 1 + floor(10^9 (c + 2) / (N + 2 V)), and f(p, q) = floor((p - q)^2 / (p + q)).  The sum of f over all kept terms for two
groups s and t is never built over the terms that neither has: with p0 the p of count 0,

    sum = sum over terms of both [f(p_s, p_t) - f(p_s, p0_t) - f(p0_s, p_t) + f(p0_s, p0_t)]
        + sum over terms of s [f(p_s, p0_t) - f(p0_s, p0_t)] + sum over terms of t [f(p0_s, p_t) - f(p0_s, p0_t)]
        + V f(p0_s, p0_t).

Shards give the first line; the second needs only how often each p occurs in a group.  All arithmetic is in whole numbers.

Null text, lang and source count as ''.  Groups without terms take part with count 0 everywhere; a language without kept
terms has value 0 in all its pairs and no terms.  Repeated rows count each time, also as documents.  An empty table gives no rows.
Other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Scratch, pieces, slices, spread_join, text_bytes

#: bytes of text that a task counts at once, and rows after which it sums up or hands on what it holds
CHUNK_BYTES, HELD_ROWS = 12 << 20, 2_000_000

#: groups (lang, source) up to which their totals, about 100 bytes each, are broadcast
BROADCAST_GROUPS = 200_000

#: ASCII letters in lower case and all other characters as they are; every other ASCII character parts terms
_TERM_TABLE = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 97 <= b <= 122 else 32 for b in range(256))

COUNT_COLUMNS = "lang string, source string, term string, n long, df long"
KEPT_COLUMNS = "lang string, source string, term string, n long, lead long"
PART_COLUMNS = "kind string, lang string, source string, item string, value long, n long"

KEPT_SQL = """
WITH summed AS (SELECT lang, source, term, sum(n)::BIGINT AS n, sum(df) AS df FROM held GROUP BY ALL),
kept AS (SELECT lang, term, min(source) AS first FROM summed WHERE term IS NOT NULL GROUP BY ALL HAVING sum(df) >= $min_docs)
SELECT lang, source, term, n, (source = first)::BIGINT AS lead FROM summed JOIN kept USING (lang, term)
UNION ALL SELECT lang, source, NULL, 0, 0 FROM summed WHERE term IS NULL
"""

SCORED_SQL = """
CREATE TABLE scored AS SELECT lang, source, term,
  (1 + (1000000000::HUGEINT * (n + 2)) // (total + 2 * v))::BIGINT AS p, (1 + 2000000000 // (total + 2 * v))::BIGINT AS p0,
  (1 + (1000000000::HUGEINT * (sum(n) OVER (PARTITION BY lang, term) + 2)) // (lang_total + 2 * v))::BIGINT AS q
FROM held
"""

PARTS_SQL = """
SELECT 'pair' AS kind, a.lang, a.source, b.source AS item,
  sum(f(a.p, b.p) - f(a.p, b.p0) - f(a.p0, b.p) + f(a.p0, b.p0))::BIGINT AS value, 0::BIGINT AS n
FROM scored a JOIN scored b ON a.lang = b.lang AND a.term = b.term AND a.source < b.source GROUP BY ALL
UNION ALL SELECT 'share', lang, source, NULL, p, count(*) FROM scored GROUP BY ALL
UNION ALL (
  SELECT 'term', lang, source, term, f(p, q), 0 FROM scored WHERE p > q
  QUALIFY row_number() OVER (PARTITION BY lang, source ORDER BY f(p, q) DESC, term) <= $top)
"""


def _connect():
    """DuckDB of one thread, in memory alone: it never writes to the machine's disk."""
    import duckdb

    con = duckdb.connect(":memory:", config={"threads": 1, "memory_limit": "1GB", "temp_directory": ""})
    con.execute("CREATE MACRO f(a, b) AS ((a - b) * (a - b)) // (a + b)")
    return con


def _batches(con, sql: str, columns: str, values: dict | None = None):
    found = con.sql(sql, params=values) if values else con.sql(sql)
    names = [c.split()[0] for c in columns.split(", ")]
    yield from found.to_arrow_table().select(names).to_batches(max_chunksize=50_000)


_SUM_HELD = "CREATE OR REPLACE TABLE held AS SELECT lang, source, term, sum(n)::BIGINT AS n, sum(df)::BIGINT AS df FROM held GROUP BY ALL"
_HELD = "CREATE OR REPLACE TABLE held (lang VARCHAR, source VARCHAR, term VARCHAR, n BIGINT, df BIGINT)"


def _split(texts: list[bytes], docs: list[int]):
    """(doc, term) of every term of ``texts``, as an Arrow table."""
    import pyarrow as pa
    import pyarrow.compute as pc

    found = pc.ascii_split_whitespace(pa.array(texts, pa.binary()).cast(pa.string()))
    return pa.table({"doc": pc.take(pa.array(docs, pa.int64()), pc.list_parent_indices(found)), "term": found.flatten()})


def _count_chunk(con, rows: list[tuple[str, str, bytes]]) -> None:
    """Add the counts of whole documents (lang, source, text) to ``held``; long texts go through it in pieces."""
    import pyarrow as pa

    con.register("docs", pa.table({"doc": range(len(rows)), "lang": [r[0] for r in rows], "source": [r[1] for r in rows]}))
    con.execute("CREATE OR REPLACE TABLE spots (doc BIGINT, term VARCHAR, n BIGINT)")
    texts = [(k, r[2].translate(_TERM_TABLE)) for k, r in enumerate(rows)]
    parts = [([t for _, t in texts], [k for k, _ in texts])]
    if len(rows) == 1:
        parts = (([piece], [0]) for piece in pieces(texts[0][1], CHUNK_BYTES))
    n = 0
    for n, (part, docs) in enumerate(parts, 1):
        con.register("tokens", _split(part, docs))
        con.execute("INSERT INTO spots SELECT doc, term, count(*) FROM tokens WHERE term <> '' GROUP BY ALL")
    spots = "spots" if n == 1 else "(SELECT doc, term, sum(n) AS n FROM spots GROUP BY ALL)"
    con.execute(f"INSERT INTO held SELECT lang, source, term, sum(n), count(*) FROM {spots} JOIN docs USING (doc) GROUP BY ALL")
    con.execute("INSERT INTO held SELECT DISTINCT lang, source, NULL, 0, 0 FROM docs")


def _size(con) -> int:
    return con.execute("SELECT count(*) FROM held").fetchall()[0][0]


def _counted(batches):
    con = _connect()
    con.execute(_HELD)
    rows, size = [], 0
    for batch in slices(batches, 256):
        for row in zip(batch.column("lang").to_pylist(), batch.column("source").to_pylist(), text_bytes(batch.column("text")), strict=True):
            if rows and size + len(row[2]) > CHUNK_BYTES:
                _count_chunk(con, rows)
                rows, size = [], 0
                if _size(con) > HELD_ROWS:
                    con.execute(_SUM_HELD)
                    if _size(con) > HELD_ROWS // 2:
                        yield from _batches(con, "FROM held", COUNT_COLUMNS)
                        con.execute(_HELD)
            rows.append(row)
            size += len(row[2])
    if rows:
        _count_chunk(con, rows)
    con.execute(_SUM_HELD)
    yield from _batches(con, "FROM held", COUNT_COLUMNS)


def _hold(con, batches, sums: bool) -> bool:
    """Load a shard's batches into ``held``; where ``sums``, rows of the same term and group are added up on the way."""
    import pyarrow as pa

    waiting, there = [], False

    def load():
        con.register("more", pa.Table.from_batches(waiting))
        con.execute("INSERT INTO held FROM more" if there else "CREATE OR REPLACE TABLE held AS FROM more")
        waiting.clear()

    for batch in batches:
        waiting.append(batch)
        if sum(b.num_rows for b in waiting) >= 200_000:
            load()
            there = True
            if sums and _size(con) > HELD_ROWS:
                con.execute(_SUM_HELD)
    if waiting:
        load()
        there = True
    return there


def _kept(min_docs: int):
    def run(batches):
        con = _connect()
        if _hold(con, batches, sums=True):
            yield from _batches(con, KEPT_SQL, KEPT_COLUMNS, {"min_docs": min_docs})

    return run


def _parts(top: int):
    def run(batches):
        con = _connect()
        if _hold(con, batches, sums=False):
            con.execute(SCORED_SQL)
            con.execute("DROP TABLE held")
            yield from _batches(con, PARTS_SQL, PART_COLUMNS, {"top": top})

    return run


def kept_counts(docs: DataFrame, min_docs: int, shards: int) -> DataFrame:
    """(lang, source, term, n, lead) of the kept terms; ``lead`` is 1 in one row of each term.  Groups have a row without term."""
    empty = F.lit("")
    texts = docs.select(F.coalesce("lang", empty).alias("lang"), F.coalesce("source", empty).alias("source"), "text")
    counts = texts.mapInArrow(_counted, COUNT_COLUMNS)
    return counts.repartition(shards, "lang", "term").mapInArrow(_kept(min_docs), KEPT_COLUMNS)


def _diff(p: str, q: str) -> str:
    """f as SQL; both p are 0 only in a language without kept terms."""
    return f"((({p} - {q}) * ({p} - {q})) div greatest({p} + {q}, 1))"


def divergence(docs: DataFrame, min_docs: int = 10, top: int = 10) -> DataFrame:
    """lang, source, part, item, value and rank.

    Part ``pair``: every other source of the lang by the sum of f; part ``term``: the ``top`` terms of the source that it has
    more often than the language has, by f.  Ties go to the smaller item in UTF-8.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "divergence")
    shards = max(spark.sparkContext.defaultParallelism, 2 * docs.rdd.getNumPartitions())
    kept = scratch.put(kept_counts(docs, min_docs, shards), "kept")
    lang = Window.partitionBy("lang")
    sums = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.sum("lead").alias("lead"))
    sums = sums.select("lang", "source", "total", F.sum("total").over(lang).alias("lang_total"), F.sum("lead").over(lang).alias("v"))
    groups = scratch.put(sums.withColumn("p0", F.expr("if(v > 0, 1 + 2000000000 div (total + 2 * v), 0)")), "groups")
    few = groups.count() <= BROADCAST_GROUPS
    totals = groups.select(F.struct("lang", "source").alias("group"), "total", "lang_total", "v")
    terms = kept.where("term is not null").select(F.struct("lang", "source").alias("group"), "lang", "source", "term", "n")
    told = terms.join(F.broadcast(totals), "group") if few else spread_join(terms, totals, "group", F.xxhash64("term"))
    told = told.select("lang", "source", "term", "n", "total", "lang_total", "v").repartition(shards, "lang", "term")
    parts = scratch.put(told.mapInArrow(_parts(top), PART_COLUMNS), "parts")
    others = groups.select("lang", F.col("source").alias("item"), F.col("p0").alias("p0_item"))
    grid = groups.join(others, "lang").where("source <> item").select("lang", "source", "item", F.expr(f"v * {_diff('p0', 'p0_item')}").alias("value"))
    shares = parts.where("kind = 'share'").groupBy("lang", "source", F.col("value").alias("p")).agg(F.sum("n").alias("n"))
    own = groups.select(F.struct("lang", "source").alias("group"), "p0")
    shares = shares.withColumn("group", F.struct("lang", "source"))
    shares = shares.join(F.broadcast(own), "group") if few else spread_join(shares, own, "group", F.xxhash64("p"))
    shares = shares.join(F.broadcast(others), "lang") if few else spread_join(shares, others, "lang", F.xxhash64("source", "p"))
    alone = shares.where("source <> item").groupBy("lang", "source", "item").agg(F.sum(F.expr(f"n * ({_diff('p', 'p0_item')} - {_diff('p0', 'p0_item')})")).alias("value"))
    both = parts.where("kind = 'pair'").groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    turned = lambda rows: rows.unionByName(rows.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), "value"))
    pairs = grid.unionByName(turned(alone)).unionByName(turned(both)).groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), F.asc("item"))
    ranked = lambda rows, part: rows.select("lang", "source", F.lit(part).alias("part"), "item", "value", F.row_number().over(order).alias("rank"))
    best = ranked(parts.where("kind = 'term'"), "term").where(F.col("rank") <= top)
    out = scratch.put(ranked(pairs, "pair").unionByName(best), "ranked")
    for used in (kept, groups, parts):
        scratch.drop(used)
    return out
