"""Near-duplicate documents: minima of many universal hashes, banding, verification on full sets, components.

1. One pass hashes each text's word shingles and keeps a digest of the set, the signature (the minima) and one key per
   band of it.  Shingles are 64-bit hashes; a collision inside a set is as unlikely as one pair in 2^64.
2. Equal sets meet by digest (a partial aggregate, so a huge group of copies costs little); a 64-bit hash of the digest,
   tested to be unique, stands for them from here on, and doc_ids come back only when components are named.
3. Representatives with a band key in common are candidates.  Inside a bucket links are sought by pivots: first
   each member against one pivot, then against the pivots of all its buckets, and last the pairs that are still in
   different components.  Nothing is skipped: a pair is left untested only once both sides are known to be in
   one component, or when shingles that no partner has rule the link out.
4. Candidates are verified by their signatures, whose agreement estimates the similarity, and what passes is confirmed
   on the full shingle sets; components follow by alternating large-star and small-star.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import HUB, HUBS, LOWER_TABLE, Scratch, hub_join, slices
from .components import connected_components

ROWS = 4
#: bands, and the agreement asked of signatures, are chosen so that a pair at the threshold is missed with at most this
#: probability by either
MISS = 1e-10
SEED = 20240501
#: pivots of a bucket that its members are tested against before the pairs that are left
PIVOTS = 6
#: members that may have a shingle for it to be rare: pairs that share one are listed
RARE = 8
_MIX1, _MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def bands_for(threshold: float, rows: int = ROWS, miss: float = MISS) -> int:
    return math.ceil(math.log(miss) / math.log1p(-(threshold**rows)))


def least_agreement(threshold: float, n: int, miss: float = MISS) -> int:
    """The most equal minima of ``n`` that a pair at the threshold has fewer of with at most the probability ``miss``."""
    below = 0.0
    for k in range(n + 1):
        below += math.exp(math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1) + k * math.log(threshold) + (n - k) * math.log1p(-threshold)) if threshold < 1 else float(k == n)
        if below > miss:
            return k
    return n


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _MIX1
    x = (x ^ (x >> np.uint64(27))) * _MIX2
    return x ^ (x >> np.uint64(31))


def shingle_set(text: bytes, size: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles; fewer words than ``size`` make one shingle, none make none."""
    import xxhash

    words = text.translate(LOWER_TABLE).split()
    if not words:
        return np.zeros(0, np.uint64)
    one = xxhash.xxh3_64_intdigest
    h = np.fromiter(map(one, words), np.uint64, len(words))
    n = min(size, len(h))
    total = np.full(len(h) - n + 1, n, np.uint64)
    for k in range(n):  # order matters: mixed after every word
        total = _mix(total * np.uint64(0x9E3779B97F4A7C15) + h[k : len(h) - n + 1 + k])
    return np.unique(total)


def _universal(n: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(SEED)
    draw = lambda: rng.integers(0, 2**64, n, dtype=np.uint64)
    return draw() | np.uint64(1), draw()


def signature(shingles: np.ndarray, a: np.ndarray, b: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """(leading 32 bits of the minima of a*x+b, one key per band of ``rows`` of them)."""
    least = np.full(len(a), np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(shingles), 2048):
        part = a[:, None] * shingles[None, at : at + 2048]
        part += b[:, None]
        np.minimum(least, part.min(axis=1), out=least)
    key = np.arange(len(a) // rows, dtype=np.uint64)
    for column in (least >> np.uint64(20)).reshape(-1, rows).T:
        key = _mix(key * np.uint64(0x9E3779B97F4A7C15) + column)
    return (least >> np.uint64(32)).astype(np.uint32).view(np.int32), key.view(np.int64)


def set_digest(shingles: np.ndarray) -> bytes:
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest()


def signatures(docs: DataFrame, size: int, bands: int, rows: int) -> DataFrame:
    """(doc_id, text_hash, n_shingles, digest, minima, bands) per row of ``docs`` (doc_id, text)."""

    def run(batches):
        import pyarrow as pa

        a, b = _universal(bands * rows)
        for batch in slices(batches):
            n, digest, least, keys = [], [], [], []
            for text in batch.column(2).cast(pa.binary()).to_pylist():
                found = shingle_set(text or b"", size)
                n.append(len(found))
                digest.append(set_digest(found))
                one, other = signature(found, a, b, rows) if len(found) else (np.zeros(0, np.int32), np.zeros(0, np.int64))
                least.append(one)
                keys.append(other)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(digest, pa.binary()), _lists(least, np.int32), _lists(keys, np.int64)],
                names=["doc_id", "text_hash", "n_shingles", "digest", "minima", "bands"],
            )

    schema = "doc_id long, text_hash long, n_shingles long, digest binary, minima array<int>, bands array<long>"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), "text").mapInArrow(run, schema)


def _lists(arrays: list, kind):
    """Arrow lists of numpy arrays."""
    import pyarrow as pa

    offsets = np.concatenate(([0], np.cumsum([len(x) for x in arrays]))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([np.zeros(0, kind), *arrays])))


def _full_sets(docs: DataFrame, size: int) -> DataFrame:
    """(id, minima, shingles) of ``docs`` (id, digest, minima, text) whose text has the set of that digest."""

    def run(batches):
        import pyarrow as pa

        for batch in slices(batches):
            texts, digests = batch.column(3).cast(pa.binary()).to_pylist(), batch.column(1).to_pylist()
            sets = [shingle_set(t or b"", size) for t in texts]
            mine = pa.array([set_digest(x) == d for x, d in zip(sets, digests, strict=True)], pa.bool_())
            out = pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), _lists([x.view(np.int64) for x in sets], np.int64)], names=["id", "minima", "shingles"])
            yield out.filter(mine)

    return docs.select("id", "digest", "minima", "text").mapInArrow(run, "id long, minima array<int>, shingles array<long>")


def _with_ids(reps: DataFrame) -> DataFrame:
    """``reps`` with a 64-bit id for each digest; another seed is taken should two digests ever share one."""
    seed = 0
    while True:
        named = reps.withColumn("id", F.xxhash64("digest", F.lit(seed)))
        if named.groupBy("id").agg(F.count(F.lit(1)).alias("c")).where("c > 1").isEmpty():
            return named
        seed += 1


def _confirm(pairs: DataFrame, sets: DataFrame, percent: int, agreement: int) -> DataFrame:
    """Pairs (a, b) whose signatures agree in ``agreement`` places or more, and whose full sets reach the threshold."""
    left = sets.select(F.col("id").alias("a"), F.col("minima").alias("signed_a"), F.col("shingles").alias("of_a"))
    right = sets.select(F.col("id").alias("b"), F.col("minima").alias("signed_b"), F.col("shingles").alias("of_b"))
    equal = F.aggregate(F.zip_with("signed_a", "signed_b", lambda x, y: (x == y).cast("int")), F.lit(0), lambda n, x: n + x)
    both = pairs.join(left, "a").join(right, "b").where(equal >= agreement)
    both = both.select("a", "b", F.size("of_a").alias("na"), F.size("of_b").alias("nb"), F.size(F.array_intersect("of_a", "of_b")).alias("common"))
    return both.where(100 * F.col("common") >= percent * (F.col("na") + F.col("nb") - F.col("common"))).select("a", "b")


def _labelled(buckets: DataFrame, components: DataFrame | None) -> DataFrame:
    """Buckets that still hold members of several components: key, id, n, shared, dense, comp, members (rows of the key)."""
    if components is None:
        known = buckets.withColumn("comp", F.col("id"))
    else:
        known = buckets.join(components.withColumnRenamed("node", "id"), "id", "left").select("key", "id", "n", "shared", "dense", F.coalesce("component", "id").alias("comp"))
    open_keys = known.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count(F.lit(1)).alias("rows")).where("lo <> hi")
    return hub_join(known, open_keys.select("key", F.col("rows").alias("members"), "rows"), "key", "rows", buckets.count(), F.xxhash64("id"))


def _pivot_pairs(open_: DataFrame, pivots: int, percent: int) -> DataFrame:
    """(a, b): members against their bucket's pivots, those with the smallest share of shingles of their own."""
    central = W.partitionBy("key").orderBy((F.col("n") - F.col("shared")) / F.col("n"), "id")
    at = open_.withColumn("nth", F.row_number().over(central)).where(F.col("nth") <= pivots)
    at = at.select("key", F.col("id").alias("pivot"), F.col("comp").alias("pivot_comp"), F.col("n").alias("pivot_n"), F.col("shared").alias("pivot_shared"), F.col("members").alias("rows"))
    near = hub_join(open_, at, "key", "rows", open_.count(), F.xxhash64("id"))
    near = near.where((F.col("id") != F.col("pivot")) & (F.col("comp") != F.col("pivot_comp")) & _can_link("n", "shared", "pivot_n", "pivot_shared", percent))
    return near.select(F.greatest("id", "pivot").alias("a"), F.least("id", "pivot").alias("b"))


def _rest_pairs(open_: DataFrame, rare: DataFrame, reps: DataFrame, percent: int) -> DataFrame:
    """(a, b): all pairs in different components that the bounds leave open.

    A pair shares a rare shingle, which few members have, or it has only dense shingles in common, whose number bounds
    it; the latter is listed in the first bucket that both members are in.
    """
    apart = (F.col("x.id") > F.col("y.id")) & (F.col("x.comp") != F.col("y.comp"))
    held = rare.where("c > 1").join(open_.select("id", "n", "shared", "comp").distinct(), "id")
    by_rare = held.alias("x").join(held.alias("y"), (F.col("x.s") == F.col("y.s")) & apart & _can_link("x.n", "x.shared", "y.n", "y.shared", percent))
    told = open_.where(100 * F.col("dense") >= percent * F.col("n")).join(reps.select("id", "bands"), "id")  # what _can_link asks of either side
    first = F.try_element_at(F.array_intersect("x.bands", "y.bands"), F.lit(1)) == F.col("x.key")
    by_key = told.alias("x").join(told.alias("y"), (F.col("x.key") == F.col("y.key")) & apart & _can_link("x.n", "x.dense", "y.n", "y.dense", percent) & first)
    ends = [F.col("x.id").alias("a"), F.col("y.id").alias("b")]
    return by_rare.select(*ends).unionByName(by_key.select(*ends))


def _rare_shingles(open_: DataFrame, sets: DataFrame) -> DataFrame:
    """(s, id, c): shingles that at most RARE members of open buckets have, with how many have them.

    Shingles of very many members, of which there are HUBS at most, are dropped before the join.
    """
    held = sets.join(open_.select("id").distinct(), "id", "left_semi")
    total = held.agg(F.sum(F.size("shingles"))).first()[0] or 0
    members = held.select("id", F.explode("shingles").alias("s"))
    counts = members.groupBy("s").agg(F.count(F.lit(1)).alias("c"))
    hubs = counts.where(F.col("c") > max(HUB, total // HUBS)).select("s")
    return members.join(F.broadcast(hubs), "s", "left_anti").join(counts.where(F.col("c") <= RARE), "s").select("s", "id", "c")


def _with_shared(open_: DataFrame, rare: DataFrame, percent: int) -> DataFrame:
    """Open buckets again, with how many of a member's shingles any partner has (shared) and more than RARE have (dense).

    Shingles that no partner has count in the union of a pair only, so members with too few shared ones go.
    """
    few = rare.groupBy("id").agg(F.count_if(F.col("c") == 1).alias("own"), F.count(F.lit(1)).alias("few"))
    left = lambda c: F.col("n") - F.coalesce(c, F.lit(0))
    known = open_.select("key", "id", "n").join(few, "id", "left").select("key", "id", "n", left("own").alias("shared"), left("few").alias("dense"))
    return known.where(100 * F.col("shared") >= percent * F.col("n"))


def _can_link(n: str, shared: str, m: str, other: str, percent: int):
    """No more than the shared shingles of either can be common."""
    most = F.least(F.col(shared), F.col(other))
    return 100 * most >= percent * (F.col(n) + F.col(m) - most)


def _grouped(docs: DataFrame, shingle: int, percent: int, rows: int = ROWS) -> DataFrame:
    """(doc_id, text_hash, n_shingles, component, component_id) of every row; ``component`` is null for texts linked with nothing by rule."""
    scratch = Scratch(docs.sparkSession, "neardup")
    bands = bands_for(percent / 100, rows)
    agreement = least_agreement(percent / 100, bands * rows)
    marks = scratch.put(signatures(docs, shingle, bands, rows), "marks")
    full = marks.where("n_shingles > 0 and doc_id is not null")
    first = [F.first(c).alias(n) for c, n in (("n_shingles", "n"), ("minima", "minima"), ("bands", "bands"))]
    reps = scratch.put(_with_ids(full.groupBy("digest").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("copies"), *first)), "reps")
    keyed = reps.select(F.explode("bands").alias("key"), "id", "n")
    shared = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("key")
    buckets = scratch.put(keyed.join(shared, "key").withColumns({"shared": F.col("n"), "dense": F.col("n")}), "buckets")
    done = [buckets]
    wanted = reps.select(F.col("rep").alias("doc_id"), "id", "digest", "minima").join(buckets.select("id").distinct(), "id", "left_semi")
    sets = scratch.put(_full_sets(docs.select("doc_id", "text").join(wanted, "doc_id"), shingle).dropDuplicates(["id"]), "sets")
    done.append(sets)

    components, tested, rare = None, None, None
    for step, pivots in enumerate((1, PIVOTS, 0)):
        open_ = scratch.put(_labelled(buckets, components), "open")
        if step == 1:
            rare = scratch.put(_rare_shingles(open_, sets), "rare")
            buckets = scratch.put(_with_shared(open_, rare, percent), "bounded")
            scratch.drop(open_)
            open_ = scratch.put(_labelled(buckets, components), "open")
            done += [rare, buckets]
        pairs = _pivot_pairs(open_, pivots, percent) if pivots else _rest_pairs(open_, rare, reps, percent)
        if step == 0:
            pairs = pairs.groupBy("a").agg(F.min("b").alias("b"))
        pairs = pairs.distinct()
        if tested is not None:
            pairs = pairs.join(tested, ["a", "b"], "left_anti")
        pairs = scratch.put(pairs, "pairs")
        scratch.drop(open_)
        done.append(pairs)
        tested = pairs if tested is None else tested.unionByName(pairs)
        links = _confirm(pairs, sets, percent, agreement).select(F.col("a").alias("u"), F.col("b").alias("v"))
        if components is not None:
            links = links.unionByName(components.select(F.col("node").alias("u"), F.col("component").alias("v")))
        components = connected_components(links, scratch)
    for table in done:
        scratch.drop(table)

    placed = reps.join(components, reps["id"] == components["node"], "left").select("digest", "copies", "rep", F.coalesce("component", "id").alias("component"))
    names = placed.groupBy("component").agg(F.min("rep").alias("component_id"), F.count(F.lit(1)).alias("members"))
    placed = scratch.put(placed, "placed")
    found = hub_join(placed, names, "component", "members", reps.count(), F.xxhash64("digest"))
    kinds = ["doc_id", "text_hash", "n_shingles"]
    grouped = hub_join(full.select(*kinds, "digest"), found.select("digest", "copies", "component", "component_id"), "digest", "copies", marks.count(), F.xxhash64("doc_id"))
    alone = marks.where("n_shingles = 0 or doc_id is null").select(*kinds, F.lit(None).cast("long").alias("component"), F.col("doc_id").alias("component_id"))
    return grouped.select(*alone.columns).unionByName(alone)


def near_duplicates(docs: DataFrame, shingle: int = 5, percent: int = 80, rows: int = ROWS) -> DataFrame:
    """Group the texts of ``docs`` (doc_id, text): doc_id, n_shingles, component_id, kept.

    Two texts are linked if 100 * |A & B| >= percent * |A | B| for their sets of ``shingle``-word shingles.
    A text without words (or null) has an empty set and is linked with nothing, as is a row with a null doc_id.
    ``component_id`` is the smallest doc_id reachable; ``kept`` marks the row whose id it is (true for a null
    doc_id).  Repeated rows give repeated results, and a doc_id with two texts has a row for each, grouped by its own
    text; other columns are ignored; an empty table gives an empty result.
    """
    rows_ = _grouped(docs, shingle, percent, rows).select("doc_id", "n_shingles", "component_id")
    return rows_.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def drop_near_duplicates(docs: DataFrame, shingle: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` with one row of each group: that with the smallest doc_id (rows with a null doc_id all stay).

    Of rows that repeat doc_id and text, and of texts of one group under one doc_id, one stays; texts of different groups
    under one doc_id both stay.
    """
    found = _grouped(docs, shingle, percent).where("doc_id is not null")
    best = found.where("component is not null and doc_id = component_id").groupBy("component").agg(F.min(F.struct("doc_id", "text_hash")).alias("row"))
    alone = found.where("component is null").select(F.struct("doc_id", "text_hash").alias("row"))
    kept = best.select("row").unionByName(alone).select("row.*").distinct()
    marked = docs.where("doc_id is not null").select(F.struct(*docs.columns).alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"))
    single = marked.join(kept, ["doc_id", "text_hash"], "left_semi").dropDuplicates(["doc_id", "text_hash"]).select("row.*")
    return single.unionByName(docs.where("doc_id is null"))
