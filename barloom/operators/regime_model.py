"""Softmax models of market regimes, per bar and per session, and the routing of rules by them.

Training is full-batch gradient descent from zero weights, so it has one result.  Standardised rows are packed into blocks
once; an iteration sends the weights out, every task answers with the gradient of its blocks, and Spark adds those up.  Only
weights, means and deviations are on the driver.

Regimes: 0 and 1 are trends up and down, 2 is volatile, 3 quiet.  Ties of counts go to the smaller regime, of a session's
majority to 3 first.  Sessions are exchange days.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .indicators import choppiness, prepare, recurrences, regime_features, regimes
from .series import day_key, ratio, series

CLASSES = 4

# The regimes that each rule may trade in.  Rules that are not listed trade in all.
ROUTER = {
    "EMA": (0, 1), "SMA": (0, 1), "HMA": (0, 1), "DEMA": (0, 1), "KAMA": (0, 1), "MACD": (0, 1), "SuperTrend": (0, 1),
    "ADX": (0, 1), "Aroon": (0, 1), "VWMA": (0, 1), "TrendRegime": (0, 1), "CVD": (0, 1, 2),
    "Bollinger": (2, 3), "RSI": (2, 3), "Stochastic": (2, 3), "CRSI": (2, 3), "CMO": (2, 3), "Fisher": (2, 3),
    "VWAP": (2, 3), "VWAPBands": (2, 3), "VWAPRev": (2, 3),
    "Keltner": (0, 1, 2), "Squeeze": (0, 1, 2), "SqueezeBreak": (0, 1, 2), "ChandeKroll": (0, 1, 2),
    "POC": (2, 3), "FVG": (2, 3), "Cyber": (2, 3),
    "Chop": (0, 1, 2, 3), "Regime": (0, 1, 2, 3),
    "ITrend": (0, 1), "HilbertDC": (0, 1, 2, 3), "AdaptRSI": (2, 3), "AdaptBB": (2, 3),
    "Ribbon": (0, 1), "VWAPSlope": (0, 1), "MACDSlope": (0, 1), "ADXDI": (0, 1), "LRSlope": (0, 1),
    "ATRPct": (0, 1, 2), "TrendFollow": (0, 1), "KaufER": (0, 1), "VolReg": (0, 1, 2, 3),
    "PctB": (2, 3), "VWAPDev": (2, 3), "VWAPMR": (2, 3),
    "BBWidth": (0, 1, 2), "ORB": (0, 1, 2), "InsideBar": (0, 1, 2, 3), "NR7": (0, 1, 2, 3),
    "VolRate": (0, 1, 2, 3), "VolSpike": (0, 1, 2),
    "DecaySlope": (0, 1, 2, 3),
}


def allowed(regime: Column, rule: str) -> Column:
    """Whether ``rule`` may trade in the regime."""
    return regime.isin(*ROUTER[rule]) if rule in ROUTER else F.lit(True)


# --- softmax ---------------------------------------------------------------------------------------------------------


@dataclass
class Softmax:
    """Weights by class and feature, with the scaling of the features they were trained on."""

    features: list[str]
    mean: np.ndarray
    deviation: np.ndarray
    weights: np.ndarray

    def scores(self) -> list[Column]:
        scaled = [(F.coalesce(F.col(f), F.lit(0.0)) - float(m)) / float(d) for f, m, d in zip(self.features, self.mean, self.deviation, strict=True)]
        return [sum((x * float(w) for x, w in zip(scaled[1:], row[1:], strict=True)), scaled[0] * float(row[0])) for row in self.weights]

    def predict(self, frame: DataFrame, into: str = "predicted", confidence: str = "confidence") -> DataFrame:
        """``frame`` with the class of the highest score (the smallest of equal ones) and its share."""
        told = frame.withColumn("_scores", F.array(*self.scores()))
        best = F.array_max("_scores")
        total = F.aggregate(F.transform("_scores", lambda s: F.exp(s - best)), F.lit(0.0), lambda a, x: a + x)
        return told.withColumns({into: (F.array_position("_scores", best) - 1).cast("int"), confidence: 1 / total}).drop("_scores")


def train_softmax(frame: DataFrame, features: list[str], label: str, scaled: int | None = None, iterations: int = 200, rate: float = 0.5, decay: float = 0.001, classes: int = CLASSES) -> Softmax:
    """Weights of a softmax model of ``label`` (0 to ``classes`` - 1) over all rows of ``frame``.

    The first ``scaled`` features (all but the last, the bias, if not said) are standardised by their means and population
    deviations, deviations of 0 count as 1.  Null features count as 0; rows with a null label are left out; without rows
    all weights are 0.
    """
    scaled = len(features) - 1 if scaled is None else scaled
    rows = frame.where(F.col(label).isNotNull()).select(*[F.coalesce(F.col(f).cast("double"), F.lit(0.0)).alias(f) for f in features], F.col(label).cast("int").alias("_label"))
    sums = rows.agg(F.count(F.lit(1)), *[f(c) for c in features[:scaled] for f in (F.avg, F.stddev_pop)]).first()
    n, told = sums[0], np.array([x or 0.0 for x in sums[1:]]).reshape(scaled, 2)
    p = len(features)
    mean, deviation = np.zeros(p), np.ones(p)
    mean[:scaled], deviation[:scaled] = told[:, 0], np.where(told[:, 1] > 0, told[:, 1], 1.0)
    weights = np.zeros((classes, p))
    if n == 0:
        return Softmax(features, mean, deviation, weights)

    def pack(batches):
        import pyarrow as pa

        for batch in batches:
            x = np.column_stack([batch.column(c).to_numpy(zero_copy_only=False) for c in range(p)]) if batch.num_rows else np.zeros((0, p))
            yield pa.RecordBatch.from_arrays([pa.array([((x - mean) / deviation).astype("<f8").tobytes()], pa.binary()), pa.array([batch.column(p).to_numpy().astype("<i4").tobytes()], pa.binary())], names=["x", "y"])

    blocks = rows.mapInArrow(pack, "x binary, y binary").persist()

    def gradient(now: np.ndarray):
        def run(batches):
            import pyarrow as pa

            total = np.zeros((classes, p))
            for batch in batches:
                for xs, ys in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    x, y = np.frombuffer(xs, "<f8").reshape(-1, p), np.frombuffer(ys, "<i4")
                    s = x @ now.T
                    share = np.exp(s - s.max(axis=1, keepdims=True)) if len(s) else s
                    share /= share.sum(axis=1, keepdims=True)
                    share[np.arange(len(y)), y] -= 1
                    total += share.T @ x
            yield pa.RecordBatch.from_arrays([pa.array([total.ravel().tolist()], pa.list_(pa.float64()))], names=["g"])

        return run

    for _ in range(iterations):
        parts = blocks.mapInArrow(gradient(weights), "g array<double>")
        g = np.array(parts.agg(F.array(*[F.sum(F.col("g")[k]) for k in range(classes * p)])).first()[0])
        weights = weights - rate * (g.reshape(classes, p) / n + decay * weights)
    blocks.unpersist()
    return Softmax(features, mean, deviation, weights)


# --- bars ------------------------------------------------------------------------------------------------------------

BAR_FEATURES = [f"f{k}" for k in range(10)]


def regime_targets(labelled: DataFrame, horizon: int = 15) -> DataFrame:
    """``labelled`` (symbol, ts, regime) with ``target``: the regime that most of the bar and the next ones have, ``horizon`` in all."""
    ahead = series().rowsBetween(0, horizon - 1)
    counts = [F.struct(F.count_if(F.col("regime") == c).over(ahead).alias("n"), F.lit(-c).alias("c")) for c in range(CLASSES)]
    return labelled.withColumn("target", (-F.array_max(F.array(*counts))["c"]).cast("int"))


def regime_model(bars: DataFrame, share: float = 0.6, horizon: int = 15, iterations: int = 200) -> DataFrame:
    """(symbol, ts, regime, target, predicted, confidence, trained): a model of what the rules will say, learnt from the bars
    in the first ``share`` of the time."""
    ends = bars.agg(F.min(F.unix_micros(F.col("ts").cast("timestamp"))), F.max(F.unix_micros(F.col("ts").cast("timestamp")))).first()
    told = regime_targets(regimes(bars), horizon).join(regime_features(bars), ["symbol", "ts"])
    cut = None if ends[0] is None else ends[0] + int((ends[1] - ends[0]) * share)
    told = told.withColumn("trained", F.unix_micros(F.col("ts").cast("timestamp")) <= F.lit(cut).cast("long")).persist()
    model = train_softmax(told.where("trained"), BAR_FEATURES, "target", iterations=iterations)
    return model.predict(told).select("symbol", "ts", "regime", "target", "predicted", "confidence", "trained")


# --- sessions --------------------------------------------------------------------------------------------------------

DAY_FEATURES = [f"d{k}" for k in range(8)]
DAY_INPUTS = [*DAY_FEATURES, *[f"was_{c}" for c in range(CLASSES)], "bias"]


def day_features(bars: DataFrame) -> DataFrame:
    """(symbol, day, d0 to d7) of every session: choppiness, ADX and rank of the volatility at its last bar, range, gap, means'
    distance, change, volume.  Neutral values stand where an indicator is not warm."""
    base = prepare(recurrences(bars, "adx", "atr", "ema")).withColumn("day", day_key(F.col("ts")))
    vol = F.when(F.col("close") > 0, F.col("atr") / F.col("close")).otherwise(0.0)
    base = base.withColumn("_vol", vol)
    now = F.coalesce("atr", F.lit(1e-9)) / F.coalesce(F.nullif("close", F.lit(0.0)), F.lit(1.0))
    past = F.collect_list(F.coalesce("_vol", F.lit(float("inf")))).over(series().rowsBetween(-100, -1))
    rank = F.when(F.size(past) > 0, F.size(F.filter(past, lambda x: x < now)) / F.size(past)).otherwise(0.5)
    distance = F.coalesce(F.col("ema_20") - F.col("ema_50"), F.lit(0.0)) / F.coalesce("atr", F.lit(1e-9))
    base = base.withColumns({"_chop": F.coalesce(choppiness(), F.lit(62.0)) / 100, "_adx": F.coalesce("adx", F.lit(20.0)) / 100, "_rank": rank, "_distance": distance})
    last = lambda c: F.max_by(c, "ts")
    days = base.groupBy("symbol", "day").agg(
        last("_chop").alias("d0"), last("_adx").alias("d1"), last("_rank").alias("d2"), F.max("high").alias("_high"), F.min("low").alias("_low"),
        last("_distance").alias("d5"), last("close").alias("_close"), F.min_by("open", "ts").alias("_open"), F.sum("volume").alias("_volume"), F.count(F.lit(1)).alias("_n"),
    )
    before = F.lag("_close").over(Window.partitionBy("symbol").orderBy("day"))
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return days.withColumns(
        {
            "d3": zero(F.when(F.col("_close") > 0, (F.col("_high") - F.col("_low")) / F.col("_close"))),
            "d4": zero(ratio(F.col("_open") - before, before)),
            "d6": zero(F.when(F.col("_close") > 0, ratio(F.col("_close") - F.col("_open"), F.col("_open")))),
            "d7": F.least(F.lit(3.0), zero("_volume") / (F.col("_n") * 20000)),
        }
    ).select("symbol", "day", *DAY_FEATURES)


def day_rule_labels(labelled: DataFrame) -> DataFrame:
    """(symbol, day, label): the regime that most bars of the session have; of equal ones 3, else the smallest."""
    counts = [F.struct(F.count_if(F.col("regime") == c).alias("n"), F.lit(1 if c == 3 else -c).alias("c")) for c in range(CLASSES)]
    best = F.array_max(F.array(*counts))["c"]
    return labelled.groupBy("symbol", day_key(F.col("ts")).alias("day")).agg(F.when(best == 1, 3).otherwise(-best).cast("int").alias("label"))


def day_inputs(features: DataFrame, labels: DataFrame) -> DataFrame:
    """(symbol, day, label, session, inputs): a session with what was known before it, from the second session on.

    Inputs are the features of the session before, its label one-hot (from the third session on) and 1.
    """
    order = Window.partitionBy("symbol").orderBy("day")
    rows = features.join(labels, ["symbol", "day"]).withColumn("session", F.row_number().over(order))
    was = F.when(F.col("session") > 2, F.lag("label").over(order))
    hot = {f"was_{c}": F.coalesce((was == c).cast("double"), F.lit(0.0)) for c in range(CLASSES)}
    known = rows.withColumns({**{d: F.lag(d).over(order) for d in DAY_FEATURES}, **hot, "bias": F.lit(1.0)})
    return known.select("symbol", "day", "label", "session", *DAY_INPUTS)


def day_routing(bars: DataFrame, source: str = "rules", gate: float = 0.6, least: int = 5, trainable: int = 20, iterations: int = 500) -> DataFrame:
    """(symbol, day, session, label, predicted, confidence, fallback): the regime by which each session is routed.

    ``rules`` takes the session's own rule label; ``ml`` a softmax model of the sessions before, one for all symbols, and
    falls back where there is no session before or the confidence is below ``gate``.  Symbols with fewer than ``least``
    sessions aren't routed at all; a model with fewer than ``trainable`` rows gives way to the rules.
    """
    if source not in ("rules", "ml"):
        raise ValueError("source is rules or ml")
    labels = day_rule_labels(regimes(bars))
    order = Window.partitionBy("symbol").orderBy("day")
    days = labels.withColumns({"session": F.row_number().over(order), "_sessions": F.count(F.lit(1)).over(Window.partitionBy("symbol"))})
    ruled = days.withColumns({"predicted": F.col("label"), "confidence": F.lit(1.0)})
    if source == "ml":
        inputs = day_inputs(day_features(bars), labels).persist()
        rows = inputs.where("session > 1")
        if rows.count() >= trainable:
            model = train_softmax(rows, DAY_INPUTS, "label", scaled=len(DAY_FEATURES), iterations=iterations)
            told = model.predict(rows).select("symbol", "day", "predicted", "confidence")
            ruled = days.join(told, ["symbol", "day"], "left")
    low = F.coalesce(F.col("confidence") < gate, F.lit(True)) | (F.col("_sessions") < least)
    return ruled.select("symbol", "day", "session", "label", "predicted", "confidence", low.alias("fallback"))


def day_mask(bars: DataFrame, days: DataFrame, rule: str) -> DataFrame:
    """``bars`` with ``trade`` and ``fallback``: whether the session's regime lets ``rule`` trade; fallback sessions trade."""
    told = days.select("symbol", "day", "predicted", F.col("fallback"))
    joined = bars.withColumn("day", day_key(F.col("ts"))).join(told, ["symbol", "day"], "left")
    back = F.coalesce("fallback", F.lit(True))
    return joined.withColumns({"trade": back | F.coalesce(allowed(F.col("predicted"), rule), F.lit(True)), "fallback": back}).drop("day", "predicted")
