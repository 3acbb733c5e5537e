"""Registry of the engine's own queries and the SQL each is held against.

Floating results are rounded on both sides, so the comparison does not hang on the order of sums.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import audits as aud
from ..operators import buyonly as buy
from ..operators import capability as cap
from ..operators import gates as gat
from ..operators import indicators as ind
from ..operators import inference as inf
from ..operators import lattice as lat
from ..operators import paths as pth
from ..operators import predicates as prd
from ..operators import premium as prm
from ..operators import regime_model as reg
from ..operators import relations as rel
from ..operators import scans as scn
from ..operators import scoring as sco
from ..operators import series as ser
from ..operators import states as sta
from ..operators import trading as trd
from ..sources.tables import BARS_SQL, CHAIN_SQL, TRADES_SQL, bars, chain, trades

_QUERIES: dict[str, Callable] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None, *ctes: str):
    def add(f):
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = ("WITH " + ", ".join(ctes) + " " if ctes else "") + sql
        return f

    return add


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def rounded(df: DataFrame, digits: int = 5) -> DataFrame:
    """Doubles rounded; the sign of zero dropped."""
    return df.select(*[(F.round(c, digits) + 0.0).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def r(*names: str, digits: int = 5) -> str:
    return ", ".join(f"round({n}, {digits}) + 0.0 AS {n.rpartition('.')[2]}" for n in names)


_W = "OVER (PARTITION BY symbol ORDER BY ts"
#: bars with their one- to fifteen-bar returns
RETURNS_SQL = "ret AS (SELECT *, " + ", ".join(f"(close / nullif(lag(close, {n}) {_W}), 0) - 1) * 100 AS return_{n}" for n in (1, 2, 3, 5, 10, 15)) + " FROM bars)"
CRET_SQL = RETURNS_SQL.replace("FROM bars", "FROM chain").replace("ret AS", "cret AS")


# --- bars ------------------------------------------------------------------------------------------------------------


@query(
    f"SELECT symbol, position, count(*) AS n FROM (SELECT symbol, CASE WHEN k < 20 THEN 0 WHEN close > m THEN 1 ELSE -1 END AS position FROM (SELECT symbol, close, avg(close) {_W} ROWS 19 PRECEDING) AS m, count(*) {_W} ROWS 19 PRECEDING) AS k FROM bars)) GROUP BY ALL",
    BARS_SQL,
)
def sma_signal(spark, sf_dir):
    s = ind.signals(bars(spark, sf_dir), "SMA")
    return s.groupBy("symbol", "position").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT symbol, ts, open, high, low, close, volume FROM bars", BARS_SQL)
def bars_from_events(spark, sf_dir):
    return bars(spark, sf_dir)


@query("SELECT ts, expiry, strike, option_type, symbol, open, high, low, close, volume, oi FROM chain", CHAIN_SQL)
def chain_from_lineitem(spark, sf_dir):
    return chain(spark, sf_dir)


@query(
    "SELECT symbol, time_bucket(INTERVAL 4 HOURS, ts + INTERVAL 330 MINUTES, TIMESTAMP '1970-01-01') - INTERVAL 330 MINUTES AS ts, arg_min(open, ts) AS open, max(high) AS high, min(low) AS low, arg_max(close, ts) AS close, sum(volume) AS volume, count(*) AS n_bars FROM bars GROUP BY ALL",
    BARS_SQL,
)
def resample_4h(spark, sf_dir):
    return ser.resample(bars(spark, sf_dir), 240)


@query(
    "SELECT symbol, CAST(CASE WHEN hour(l) < 6 THEN CAST(l AS DATE) - 1 ELSE CAST(l AS DATE) END AS TIMESTAMP) AS ts, arg_min(open, t) AS open, max(high) AS high, min(low) AS low, arg_max(close, t) AS close, sum(volume) AS volume, count(*) AS n_bars FROM (SELECT *, ts AS t, ts + INTERVAL 330 MINUTES AS l FROM bars) GROUP BY symbol, 2",
    BARS_SQL,
)
def resample_session_day(spark, sf_dir):
    return ser.resample(bars(spark, sf_dir), 1440)


@query(
    f"SELECT symbol, round(median(gap), 4) AS gap, CAST(60 AS INT) AS minutes FROM (SELECT symbol, epoch(ts - lag(ts) {_W})) / 60 AS gap FROM bars) WHERE gap > 0 GROUP BY symbol",
    BARS_SQL,
)
def bar_frequency(spark, sf_dir):
    return ser.frequency(bars(spark, sf_dir))


@query(
    "SELECT day, unnest(range(a, b + INTERVAL 1 SECOND, INTERVAL 1 HOUR)) AS ts FROM (SELECT CAST(ts AS DATE) AS day, min(ts) AS a, max(ts) AS b FROM bars GROUP BY 1)",
    BARS_SQL,
)
def session_grid(spark, sf_dir):
    return ser.session_grid(bars(spark, sf_dir))


@query(
    "SELECT d.symbol, count(*) AS slots, count(b.ts) AS present FROM (SELECT DISTINCT symbol, CAST(ts AS DATE) AS day FROM bars) d JOIN (SELECT day, unnest(range(a, b + INTERVAL 1 SECOND, INTERVAL 1 HOUR)) AS ts FROM (SELECT CAST(ts AS DATE) AS day, min(ts) AS a, max(ts) AS b FROM bars GROUP BY 1)) g USING (day) LEFT JOIN bars b ON b.symbol = d.symbol AND b.ts = g.ts GROUP BY ALL",
    BARS_SQL,
)
def align_to_grid(spark, sf_dir):
    a = ser.align_to_grid(bars(spark, sf_dir))
    return a.groupBy("symbol").agg(F.count(F.lit(1)).alias("slots"), F.count_if("present").alias("present"))


@query(
    "SELECT symbol, k AS cluster, min(ts) AS start, max(ts) AS stop, count(*) AS n FROM (SELECT symbol, ts, sum(f) OVER (PARTITION BY symbol ORDER BY ts) AS k FROM (SELECT event_type AS symbol, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY event_type ORDER BY ts) <= INTERVAL 10 MINUTES THEN 0 ELSE 1 END AS f FROM events)) GROUP BY ALL"
)
def event_clusters(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("event_type").alias("symbol"), F.col("ts").cast("timestamp_ntz").alias("ts"))
    return ser.clusters(e, "10 minutes")


@query(
    "SELECT symbol, count(*) FILTER (m BETWEEN 555 AND 930) AS in_session, count(*) FILTER ((m >= 600 AND m < 660) OR (m >= 780 AND m < 840)) AS in_windows FROM (SELECT symbol, hour(ts + INTERVAL 330 MINUTES) * 60 + minute(ts + INTERVAL 330 MINUTES) AS m FROM bars) GROUP BY symbol",
    BARS_SQL,
)
def session_masks(spark, sf_dir):
    b = bars(spark, sf_dir)
    return b.groupBy("symbol").agg(
        F.count_if(ser.session_mask(F.col("ts"), "09:15", "15:30")).alias("in_session"), F.count_if(ser.window_mask(F.col("ts"), [("10:00", "11:00"), ("13:00", "14:00")])).alias("in_windows")
    )


@query(
    f"SELECT symbol, count(*) FILTER (f) AS raw, count(*) FILTER (f AND size >= 3) AS kept FROM (SELECT symbol, f, count(*) OVER (PARTITION BY symbol, k) AS size FROM (SELECT symbol, ts, f, sum(c) {_W}) AS k FROM (SELECT symbol, ts, f, CASE WHEN f <> lag(f) {_W}) THEN 1 ELSE 0 END AS c FROM (SELECT symbol, ts, close > 50 AS f FROM bars)))) GROUP BY symbol",
    BARS_SQL,
)
def mask_persistence(spark, sf_dir):
    b = bars(spark, sf_dir).withColumn("f", F.col("close") > 50)
    return ser.mask_persistence(b, "f", 3).groupBy("symbol").agg(F.count_if("f").alias("raw"), F.count_if("kept").alias("kept"))


# --- features --------------------------------------------------------------------------------------------------------


@query(
    f"SELECT symbol, ts, {r(*[f'return_{n}' for n in (1, 2, 3, 5, 10, 15)], 'accel_1_2', 'accel_1_3', 'accel_3_10')} FROM (SELECT *, return_1 - return_2 AS accel_1_2, return_1 - return_3 AS accel_1_3, return_3 - return_10 * CAST(0.3 AS DOUBLE) AS accel_3_10 FROM ret)",
    BARS_SQL,
    RETURNS_SQL,
)
def feature_returns(spark, sf_dir):
    return rounded(ser.returns(bars(spark, sf_dir)).drop("open", "high", "low", "close", "volume"))


@query(
    f"SELECT symbol, ts, CAST(CASE WHEN s > 0 THEN k ELSE 0 END AS INT) AS up_bars, CAST(CASE WHEN s < 0 THEN k ELSE 0 END AS INT) AS down_bars, CAST(CASE WHEN s <> 0 THEN k ELSE 0 END AS INT) AS streak FROM (SELECT *, row_number() OVER (PARTITION BY symbol, run ORDER BY ts) AS k FROM (SELECT *, sum(c) {_W}) AS run FROM (SELECT *, CASE WHEN s = lag(s) {_W}) THEN 0 ELSE 1 END AS c FROM (SELECT symbol, ts, coalesce(sign(return_1), 0) AS s FROM ret))))",
    BARS_SQL,
    RETURNS_SQL,
)
def feature_streaks(spark, sf_dir):
    return ser.streaks(ser.returns(bars(spark, sf_dir))).select("symbol", "ts", "up_bars", "down_bars", "streak")


@query(
    f'SELECT symbol, ts, round("range", 5) + 0.0 AS "range", {r("body", "body_pct", "upper_wick", "lower_wick", "close_location", "body_to_range")} FROM (SELECT symbol, ts, high - low AS "range", close - open AS body, (close - open) / nullif(open, 0) * 100 AS body_pct, high - greatest(open, close) AS upper_wick, least(open, close) - low AS lower_wick, (close - low) / nullif(high - low, 0) AS close_location, abs(close - open) / nullif(high - low, 0) AS body_to_range FROM bars)',
    BARS_SQL,
)
def feature_candles(spark, sf_dir):
    return rounded(ser.candles(bars(spark, sf_dir)).drop("open", "high", "low", "close", "volume"))


_F120 = f"{_W} ROWS BETWEEN 120 PRECEDING AND 1 PRECEDING)"


@query(
    f"SELECT symbol, ts, {r('rolling_high', 'rolling_low', 'volume_zscore', 'distance_from_mean', 'range_position')} FROM (SELECT *, (close / nullif(rolling_mean, 0) - 1) * 100 AS distance_from_mean, (close - rolling_low) / nullif(rolling_high - rolling_low, 0) AS range_position FROM (SELECT symbol, ts, close, CASE WHEN count(*) {_F120} >= 20 THEN avg(close) {_F120} END AS rolling_mean, CASE WHEN count(*) {_F120} >= 20 THEN max(high) {_F120} END AS rolling_high, CASE WHEN count(*) {_F120} >= 20 THEN min(low) {_F120} END AS rolling_low, CASE WHEN count(*) {_F120} >= 20 THEN (volume - avg(volume) {_F120}) / nullif(stddev_samp(volume) {_F120}, 0) END AS volume_zscore FROM bars))",
    BARS_SQL,
)
def feature_trailing(spark, sf_dir):
    return rounded(ser.trailing(bars(spark, sf_dir)).select("symbol", "ts", "rolling_high", "rolling_low", "volume_zscore", "distance_from_mean", "range_position"))


def _prior(n: int) -> str:
    return f"{_W} ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING)"


@query(
    f"SELECT symbol, ts, {r('atr_range', 'atr_true', 'range_expansion', 'realized_vol_20')} FROM (SELECT symbol, ts, CASE WHEN count(rg) {_prior(14)} >= 5 THEN avg(rg) {_prior(14)} END AS atr_range, CASE WHEN count(tr) {_prior(14)} >= 5 THEN avg(tr) {_prior(14)} END AS atr_true, rg / nullif(CASE WHEN count(rg) {_prior(10)} >= 5 THEN avg(rg) {_prior(10)} END, 0) AS range_expansion, CASE WHEN count(rr) {_prior(20)} >= 10 THEN stddev_samp(rr) {_prior(20)} END AS realized_vol_20 FROM (SELECT symbol, ts, high - low AS rg, greatest(high - low, abs(high - p), abs(low - p)) AS tr, close / nullif(p, 0) - 1 AS rr FROM (SELECT *, lag(close) {_W}) AS p FROM bars)))",
    BARS_SQL,
)
def feature_volatility(spark, sf_dir):
    return rounded(ser.volatility(bars(spark, sf_dir)).select("symbol", "ts", "atr_range", "atr_true", "range_expansion", "realized_vol_20"))


@query(
    f"SELECT symbol, ts, {r('range_pct', digits=4)} FROM (SELECT a.symbol, a.ts, CASE WHEN count(*) >= 20 THEN 100.0 * count(*) FILTER (b.rg <= a.rg) / count(*) END AS range_pct FROM (SELECT symbol, ts, high - low AS rg, row_number() {_W}) AS k FROM bars) a JOIN (SELECT symbol, high - low AS rg, row_number() {_W}) AS k FROM bars) b ON a.symbol = b.symbol AND b.k BETWEEN a.k - 119 AND a.k GROUP BY a.symbol, a.ts)",
    BARS_SQL,
)
def feature_percentile(spark, sf_dir):
    b = bars(spark, sf_dir).withColumn("range", F.col("high") - F.col("low"))
    return rounded(b.select("symbol", "ts", ser.percentile_of("range").alias("range_pct")), 4)


@query(
    f"SELECT symbol, ts, {r('rsi_14', 'ma_20', 'bb_pos', 'roc_5', 'vwap_deviation', digits=4)} FROM (SELECT symbol, ts, CASE WHEN count(d) {_W} ROWS 13 PRECEDING) >= 14 THEN 100 - 100 / nullif(1 + avg(greatest(d, 0)) {_W} ROWS 13 PRECEDING) / nullif(avg(greatest(-d, 0)) {_W} ROWS 13 PRECEDING), 0), 0) END AS rsi_14, CASE WHEN count(*) {_W} ROWS 19 PRECEDING) >= 20 THEN avg(close) {_W} ROWS 19 PRECEDING) END AS ma_20, CASE WHEN count(*) {_W} ROWS 19 PRECEDING) >= 20 THEN (close - avg(close) {_W} ROWS 19 PRECEDING)) / nullif(2 * stddev_samp(close) {_W} ROWS 19 PRECEDING), 0) END AS bb_pos, (close / nullif(lag(close, 5) {_W}), 0) - 1) * 100 AS roc_5, (close / nullif(sum((high + low + close) / 3 * volume) {_W} ROWS UNBOUNDED PRECEDING) / sum(volume) {_W} ROWS UNBOUNDED PRECEDING), 0) - 1) * 100 AS vwap_deviation FROM (SELECT *, close - lag(close) {_W}) AS d FROM bars))",
    BARS_SQL,
)
def feature_baselines(spark, sf_dir):
    return rounded(ser.baselines(bars(spark, sf_dir)).select("symbol", "ts", "rsi_14", "ma_20", "bb_pos", "roc_5", "vwap_deviation"), 4)


@query(
    f"SELECT symbol, ts, {r('momentum_5', 'momentum_10', 'gap', 'pullback', 'cumulative_return_5')} FROM (SELECT symbol, ts, CASE WHEN count(return_1) {_prior(5)} >= 5 THEN avg(return_1) {_prior(5)} END AS momentum_5, CASE WHEN count(return_1) {_prior(10)} >= 5 THEN avg(return_1) {_prior(10)} END AS momentum_10, (open / nullif(lag(close) {_W}), 0) - 1) * 100 AS gap, (max(high) {_W} ROWS 5 PRECEDING) - close) / nullif(max(high) {_W} ROWS 5 PRECEDING), 0) * 100 AS pullback, CASE WHEN count(return_1) {_prior(5)} >= 5 THEN sum(return_1) {_prior(5)} END AS cumulative_return_5 FROM ret)",
    BARS_SQL,
    RETURNS_SQL,
)
def feature_momentum(spark, sf_dir):
    return rounded(ser.momentum(ser.returns(bars(spark, sf_dir))).select("symbol", "ts", "momentum_5", "momentum_10", "gap", "pullback", "cumulative_return_5"))


def _ahead(n: int) -> str:
    return f"{_W} ROWS BETWEEN 1 FOLLOWING AND {n} FOLLOWING)"


LABELS_SQL = "lab AS (SELECT symbol, ts, close, high, low, return_1, return_5, " + ", ".join(
    f"(lead(close, {n}) {_W}) / nullif(close, 0) - 1) * 100 AS fwd_ret_{n}, CASE WHEN count(*) {_ahead(n)} >= {n} THEN (max(high) {_ahead(n)} / nullif(close, 0) - 1) * 100 END AS mfe_{n}, CASE WHEN count(*) {_ahead(n)} >= {n} THEN (min(low) {_ahead(n)} / nullif(close, 0) - 1) * 100 END AS mae_{n}"
    for n in (1, 3, 5, 10)
) + " FROM ret)"


@query("SELECT symbol, ts, " + r(*[f"{k}_{n}" for n in (1, 3, 5, 10) for k in ("fwd_ret", "mfe", "mae")]) + " FROM lab", BARS_SQL, RETURNS_SQL, LABELS_SQL)
def forward_labels(spark, sf_dir):
    made = ser.labels(bars(spark, sf_dir), (1, 3, 5, 10))
    return rounded(made.drop("open", "high", "low", "close", "volume"))


@query(
    "SELECT horizon, count(*) AS n, "
    + "round(avg(y), 4) AS mean, round(quantile_cont(y, 0.5), 4) AS median, round(avg(CASE WHEN y > 0 THEN 1.0 ELSE 0.0 END), 4) AS win_rate, round(quantile_cont(best, 0.9), 4) AS mfe_p90, round(quantile_cont(worst, 0.1), 4) AS mae_p10 FROM ("
    + " UNION ALL ".join(f"SELECT {n} AS horizon, fwd_ret_{n} AS y, mfe_{n} AS best, mae_{n} AS worst FROM lab WHERE return_1 > 50" for n in (1, 3, 5, 10))
    + ") WHERE y IS NOT NULL GROUP BY horizon",
    BARS_SQL,
    RETURNS_SQL,
    LABELS_SQL,
)
def return_path(spark, sf_dir):
    frame = ser.labels(ser.returns(bars(spark, sf_dir)), (1, 3, 5, 10))
    return rounded(ser.return_path(frame, F.col("return_1") > 50), 4)


@query(
    f"SELECT seq3, count(*) AS n FROM (SELECT CASE WHEN lag(s, 3) {_W}) IS NOT NULL THEN concat_ws('|', lag(s, 3) {_W}), lag(s, 2) {_W}), lag(s, 1) {_W})) END AS seq3 FROM (SELECT symbol, ts, CASE WHEN return_1 > 1 THEN 'strong_up' WHEN return_1 > 0.2 THEN 'weak_up' WHEN return_1 < -1 THEN 'strong_down' WHEN return_1 < -0.2 THEN 'weak_down' WHEN return_1 IS NOT NULL THEN 'flat' END AS s FROM ret)) WHERE seq3 IS NOT NULL GROUP BY seq3",
    BARS_SQL,
    RETURNS_SQL,
)
def state_sequences(spark, sf_dir):
    s = ser.sequences(ser.returns(bars(spark, sf_dir)))
    return s.where("seq3 is not null").groupBy("seq3").agg(F.count(F.lit(1)).alias("n"))


@query(
    f"SELECT symbol, CAST(sum(CASE WHEN abs(z) > 2.5 THEN 1 ELSE 0 END) AS BIGINT) AS large_ret, CAST(sum(CASE WHEN vz > 2 THEN 1 ELSE 0 END) AS BIGINT) AS vol_shock FROM (SELECT symbol, CASE WHEN count(return_5) {_F120} >= 20 THEN (return_5 - avg(return_5) {_F120}) / nullif(stddev_samp(return_5) {_F120}, 0) END AS z, CASE WHEN count(*) {_F120} >= 20 THEN (volume - avg(volume) {_F120}) / nullif(stddev_samp(volume) {_F120}, 0) END AS vz FROM ret) GROUP BY symbol",
    BARS_SQL,
    RETURNS_SQL,
)
def atomic_events(spark, sf_dir):
    f = ser.atomic_events(ser.volatility(ser.trailing(ser.returns(bars(spark, sf_dir)))))
    return f.groupBy("symbol").agg(F.sum("e_large_ret").alias("large_ret"), F.sum("e_vol_shock").alias("vol_shock"))


@query(
    "SELECT f AS feature, count(*) AS n, count(v) AS valid, count(DISTINCT v) AS distinct, round(1 - count(v) / count(*), 6) AS missing, CASE WHEN 1 - count(v) / count(*) < 0.2 THEN 'FULL' ELSE 'LIMITED' END AS tier, coalesce(var_samp(v) > 0, false) AS usable FROM (SELECT 'return_1' AS f, return_1 AS v FROM ret UNION ALL SELECT 'return_15', return_15 FROM ret) GROUP BY f",
    BARS_SQL,
    RETURNS_SQL,
)
def feature_quality(spark, sf_dir):
    return ser.feature_quality(ser.returns(bars(spark, sf_dir)), ["return_1", "return_15"])


@query(
    "SELECT symbol, count(*) AS n_bars, count(*) FILTER (high < greatest(open, close) OR low > least(open, close) OR high < low) AS bad_bars, count(*) - count(DISTINCT ts) AS repeated, count(DISTINCT CAST(ts AS DATE)) AS days, avg(CASE WHEN volume > 0 THEN 1.0 ELSE 0.0 END) AS volume_coverage, CASE WHEN count(*) < 200 THEN 'SHORT' ELSE 'OK' END AS status FROM bars GROUP BY symbol",
    BARS_SQL,
)
def data_health(spark, sf_dir):
    return ser.health(bars(spark, sf_dir))


# --- chain -----------------------------------------------------------------------------------------------------------


def _chain_returns(spark, sf_dir):
    return ser.returns(chain(spark, sf_dir), (1, 2, 3, 5, 10, 15))


@query(
    "SELECT a.ts, a.expiry, a.strike, round(a.return_5 - b.return_5, 5) + 0.0 AS type_ret_diff, round(a.volume / nullif(b.volume, 0), 5) + 0.0 AS type_vol_ratio, CAST(coalesce(a.return_5 > 1 AND b.return_5 < 0.5, false) AS INT) AS ev_a_leads_b FROM cret a JOIN cret b USING (ts, expiry, strike) WHERE a.option_type = 'CE' AND b.option_type = 'PE'",
    CHAIN_SQL,
    CRET_SQL,
)
def type_pairs(spark, sf_dir):
    return rounded(rel.type_pairs(_chain_returns(spark, sf_dir)).select("ts", "expiry", "strike", "type_ret_diff", "type_vol_ratio", "ev_a_leads_b"))


@query(
    "SELECT a.ts, a.expiry, a.option_type, a.strike AS strike_a, b.strike AS strike_b, round(a.return_5 - b.return_5, 5) + 0.0 AS return_5_diff, round(a.volume - b.volume, 5) + 0.0 AS volume_diff FROM cret a JOIN cret b ON a.ts = b.ts AND a.expiry = b.expiry AND a.option_type = b.option_type AND a.strike < b.strike",
    CHAIN_SQL,
    CRET_SQL,
)
def strike_pairs(spark, sf_dir):
    return rounded(rel.strike_pairs(_chain_returns(spark, sf_dir)))


@query(
    "SELECT ts, count(*) AS n, " + ", ".join(f"round(avg(return_5) FILTER (option_type = '{k}'), 5) + 0.0 AS {v}_ret, round(avg(CASE WHEN return_5 > 0 THEN 1.0 WHEN return_5 IS NOT NULL THEN 0.0 END) FILTER (option_type = '{k}'), 5) + 0.0 AS {v}_up" for k, v in (("CE", "ce"), ("PE", "pe"))) + " FROM cret GROUP BY ts",
    CHAIN_SQL,
    CRET_SQL,
)
def chain_breadth(spark, sf_dir):
    return rounded(rel.breadth(_chain_returns(spark, sf_dir)).drop("ret_diff", "up_diff"))


@query(
    "SELECT ts, count(*) AS n, CAST(sum(v * v) AS DOUBLE) / pow(CAST(sum(v) AS DOUBLE), 2) AS concentration, round(avg(return_1), 5) + 0.0 AS chain_momentum FROM (SELECT *, CAST(round(volume * 100) AS BIGINT) AS v FROM cret) GROUP BY ts",
    CHAIN_SQL,
    CRET_SQL,
)
def chain_cross_section(spark, sf_dir):
    x = rel.cross_section(_chain_returns(spark, sf_dir))
    return x.select("ts", "n", "concentration", (F.round("chain_momentum", 5) + 0.0).alias("chain_momentum"))


@query("SELECT ts, arg_min(strike, struct_pack(d := d, s := strike)) AS atm FROM (SELECT a.ts, a.strike, abs(a.close - b.close) AS d FROM chain a JOIN chain b USING (ts, strike) WHERE a.option_type = 'CE' AND b.option_type = 'PE') GROUP BY ts", CHAIN_SQL)
def parity_atm(spark, sf_dir):
    return rel.parity_atm(chain(spark, sf_dir))


@query("SELECT expiry, median(gap) AS step FROM (SELECT expiry, strike - lag(strike) OVER (PARTITION BY expiry ORDER BY strike) AS gap FROM (SELECT DISTINCT expiry, strike FROM chain)) WHERE gap > 0 GROUP BY expiry", CHAIN_SQL)
def strike_step(spark, sf_dir):
    return rel.strike_step(chain(spark, sf_dir))


@query("SELECT ts, round(coalesce((ce + pe) / 2, ce, pe), 6) AS close, high, low, volume FROM (SELECT ts, avg(close) FILTER (option_type = 'CE') AS ce, avg(close) FILTER (option_type = 'PE') AS pe, max(high) AS high, min(low) AS low, round(sum(volume), 4) AS volume FROM chain GROUP BY ts)", CHAIN_SQL)
def straddle_underlying(spark, sf_dir):
    return rounded(rel.straddle(chain(spark, sf_dir)).select("ts", "close", "high", "low", "volume"), 6)


@query("SELECT a.symbol, a.ts, b.close AS other_close FROM bars a ASOF LEFT JOIN (SELECT ts, max(close) AS close FROM bars WHERE symbol = 'click' GROUP BY ts) b ON a.ts >= b.ts WHERE a.symbol <> 'click'", BARS_SQL)
def asof_backward(spark, sf_dir):
    b = bars(spark, sf_dir)
    left = b.where("symbol <> 'click'").select(F.lit("x").alias("k"), "symbol", "ts")
    right = b.where("symbol = 'click'").select(F.lit("x").alias("k"), "ts", F.col("close").alias("other_close"))
    return rel.asof(left, right, "other_close", keys=("k",)).select("symbol", "ts", "other_close")


@query("SELECT a.symbol, a.ts, (SELECT arg_min(b.close, b.ts) FROM bars b WHERE b.symbol = 'click' AND b.ts >= a.ts) AS other_close FROM bars a WHERE a.symbol <> 'click'", BARS_SQL)
def asof_forward(spark, sf_dir):
    b = bars(spark, sf_dir)
    left = b.where("symbol <> 'click'").select(F.lit("x").alias("k"), "symbol", "ts")
    right = b.where("symbol = 'click'").select(F.lit("x").alias("k"), "ts", F.col("close").alias("other_close"))
    return rel.asof(left, right, "other_close", keys=("k",), forward=True).select("symbol", "ts", "other_close")


@query(
    "SELECT source, target, lag, count(*) AS n, round(avg(y), 4) + 0.0 AS mean, round(quantile_cont(y, 0.5), 4) + 0.0 AS median, round(avg(CASE WHEN y > 0 THEN 1.0 ELSE 0.0 END), 4) AS win_rate FROM ("
    + " UNION ALL ".join(f"SELECT source, target, {k} AS lag, moved, lead(fwd, {k}) OVER (PARTITION BY source, target ORDER BY ts) AS y FROM pairs" for k in (1, 2, 3))
    + ") WHERE abs(moved) > 1 AND y IS NOT NULL GROUP BY ALL HAVING count(*) >= 20",
    BARS_SQL,
    RETURNS_SQL,
    LABELS_SQL,
    "pairs AS (SELECT a.ts, a.symbol AS source, b.symbol AS target, a.return_1 AS moved, b.fwd_ret_5 AS fwd FROM lab a JOIN lab b ON a.ts = b.ts AND a.symbol <> b.symbol)",
)
def lead_lag(spark, sf_dir):
    return rounded(rel.lead_lag(ser.labels(ser.returns(bars(spark, sf_dir)), (5,))), 4)


@query("SELECT CASE WHEN grouping(symbol) = 0 THEN 'contract' WHEN grouping(expiry) = 0 THEN 'expiry' ELSE 'all' END AS level, expiry, symbol, count(*) AS n, round(sum(volume), 2) AS net FROM chain GROUP BY GROUPING SETS ((expiry, symbol), (expiry), ())", CHAIN_SQL)
def pooled_levels(spark, sf_dir):
    return rounded(rel.pooled_levels(chain(spark, sf_dir).withColumnRenamed("volume", "net")), 2)


@query(
    f"SELECT ts, symbol, CAST(CASE WHEN tv IS NOT NULL THEN rank() OVER (PARTITION BY ts ORDER BY tv DESC NULLS LAST) END AS INT) AS volume_rank FROM (SELECT ts, symbol, round(CASE WHEN count(*) {_prior(60)} >= 20 THEN sum(volume) {_prior(60)} END, 4) AS tv FROM chain)",
    CHAIN_SQL,
)
def selector_rank(spark, sf_dir):
    return rel.volume_rank(chain(spark, sf_dir)).select("ts", "symbol", "volume_rank")


@query("SELECT expiry, option_type, strike, ts, rank() OVER (PARTITION BY expiry, option_type ORDER BY volume) + (count(*) OVER (PARTITION BY expiry, option_type, volume) - 1) / 2 AS rank FROM chain", CHAIN_SQL)
def average_rank(spark, sf_dir):
    return rel.average_rank(chain(spark, sf_dir), "volume", "rank", ("expiry", "option_type")).select("expiry", "option_type", "strike", "ts", "rank")


# --- indicators and rules --------------------------------------------------------------------------------------------


@query(
    f"SELECT symbol, ts, {r('bb_low', 'bb_high', 'stoch', 'vwma_gap', digits=4)} FROM (SELECT symbol, ts, CASE WHEN n >= 20 THEN m - 2 * sd END AS bb_low, CASE WHEN n >= 20 THEN m + 2 * sd END AS bb_high, CASE WHEN n14 >= 14 THEN coalesce((close - l14) / nullif(h14 - l14, 0) * 100, 50) END AS stoch, CASE WHEN n >= 20 THEN (close / nullif(pv / nullif(v, 0), 0) - 1) * 100 END AS vwma_gap FROM (SELECT symbol, ts, close, count(*) {_W} ROWS 19 PRECEDING) AS n, avg(close) {_W} ROWS 19 PRECEDING) AS m, stddev_pop(close) {_W} ROWS 19 PRECEDING) AS sd, count(*) {_W} ROWS 13 PRECEDING) AS n14, max(high) {_W} ROWS 13 PRECEDING) AS h14, min(low) {_W} ROWS 13 PRECEDING) AS l14, sum(close * volume) {_W} ROWS 19 PRECEDING) AS pv, sum(volume) {_W} ROWS 19 PRECEDING) AS v FROM bars))",
    BARS_SQL,
)
def indicators_windowed(spark, sf_dir):
    b = bars(spark, sf_dir)
    lo, _, hi = ind.bollinger()
    return rounded(b.select("symbol", "ts", lo.alias("bb_low"), hi.alias("bb_high"), ind.stochastic().alias("stoch"), ((ser.ratio(F.col("close"), ind.vwma()) - 1) * 100).alias("vwma_gap")), 4)


@query(
    "SELECT symbol, ts, round(e, 5) AS ema_20 FROM seeded",
    "RECURSIVE dummy AS (SELECT 1)",
    BARS_SQL,
    f"numbered AS (SELECT symbol, ts, close, row_number() {_W}) AS k, avg(close) {_W} ROWS 19 PRECEDING) AS m FROM bars)",
    "seeded AS (SELECT symbol, ts, k, CASE WHEN k = 20 THEN m END AS e FROM numbered WHERE k <= 20 UNION ALL SELECT n.symbol, n.ts, n.k, s.e + CAST(2 AS DOUBLE) / 21 * (n.close - s.e) FROM seeded s JOIN numbered n ON n.symbol = s.symbol AND n.k = s.k + 1 WHERE s.k >= 20)",
)
def indicator_ema(spark, sf_dir):
    return rounded(ind.recurrences(bars(spark, sf_dir), "ema").select("symbol", "ts", "ema_20"))


@query()
def indicator_recurrences(spark, sf_dir):
    return ind.recurrences(bars(spark, sf_dir), *ind.KERNELS)


@query()
def rule_positions(spark, sf_dir):
    s = ind.signals(bars(spark, sf_dir), *ind.RULES, *ind.KERNEL_RULES)
    return s.groupBy("symbol", "rule", "position").agg(F.count(F.lit(1)).alias("n"))


@query()
def bar_regimes(spark, sf_dir):
    return ind.regimes(bars(spark, sf_dir)).groupBy("symbol", "regime").agg(F.count(F.lit(1)).alias("n"))


# --- trades ----------------------------------------------------------------------------------------------------------


@query(
    "SELECT exit_reason, count(*) AS n, round(avg(net), 4) AS net FROM (SELECT symbol, k, arg_min(CASE WHEN sl THEN 'SL' WHEN tp THEN 'TP' ELSE 'TIME' END, CASE WHEN sl OR tp THEN j ELSE 99 - j END) AS exit_reason, arg_min(CASE WHEN sl THEN -50.0 WHEN tp THEN 50.0 ELSE (c2 / c1 - 1) * 100 END, CASE WHEN sl OR tp THEN j ELSE 99 - j END) AS net FROM (SELECT a.symbol, a.k, b.k - a.k AS j, a.close AS c1, b.close AS c2, b.low <= a.close * CAST(0.5 AS DOUBLE) AS sl, b.high >= a.close * CAST(1.5 AS DOUBLE) AS tp FROM n a JOIN n b ON a.symbol = b.symbol AND b.k BETWEEN a.k + 1 AND a.k + 5 WHERE a.close > 0) GROUP BY symbol, k) GROUP BY exit_reason",
    BARS_SQL,
    f"n AS (SELECT *, row_number() {_W}) AS k FROM bars)",
)
def event_backtest(spark, sf_dir):
    t = trd.event_trades(bars(spark, sf_dir), F.lit(True), 5, 50.0, 50.0)
    return rounded(t.groupBy("exit_reason").agg(F.count(F.lit(1)).alias("n"), F.avg("net").alias("net")), 4)


@query(
    "SELECT hold, sl, tp, count(*) AS n, round(avg(net), 5) + 0.0 AS expectancy, round(avg(CAST(net > 0 AS DOUBLE)), 5) AS win_rate FROM (SELECT symbol, k, hold, sl, tp, arg_min(CASE WHEN hit_sl THEN -sl WHEN hit_tp THEN tp ELSE (c2 / c1 - 1) * 100 END, CASE WHEN hit_sl OR hit_tp THEN j ELSE 99 - j END) AS net FROM (SELECT a.symbol, a.k, b.k - a.k AS j, hold, sl, tp, a.close AS c1, b.close AS c2, b.low <= a.close * (1 - sl / 100) AS hit_sl, b.high >= a.close * (1 + tp / 100) AS hit_tp FROM n a JOIN n b ON a.symbol = b.symbol AND b.k BETWEEN a.k + 1 AND a.k + 5 JOIN grid ON b.k <= a.k + hold WHERE a.close > 0) GROUP BY ALL) GROUP BY hold, sl, tp",
    BARS_SQL,
    f"n AS (SELECT *, row_number() {_W}) AS k FROM bars)",
    "grid AS (SELECT CAST(h AS INT) AS hold, CAST(s AS DOUBLE) AS sl, CAST(t AS DOUBLE) AS tp FROM (SELECT unnest([3, 5]) AS h), (SELECT unnest([25, 50]) AS s), (SELECT unnest([25, 50, 100]) AS t))",
)
def exit_grid(spark, sf_dir):
    return rounded(trd.exit_grid(bars(spark, sf_dir), F.lit(True), [(h, s, t) for h in (3, 5) for s in (25, 50) for t in (25, 50, 100)]), 5)


@query()
def rule_backtest(spark, sf_dir):
    t = trd.backtest(ind.signals(bars(spark, sf_dir), "SMA", "EMA", "RSI", "SuperTrend"), sl=50.0, tp=100.0)
    return rounded(t.groupBy("symbol", "rule", "exit_reason").agg(F.count(F.lit(1)).alias("n"), F.sum("net").alias("net")), 6)


@query()
def rule_exits(spark, sf_dir):
    """Trailing stops, bar limits, fills at the signal's close and costs, over rules of every kind."""
    s = ind.signals(bars(spark, sf_dir), "SMA", "Breakout", "NR7", "Ribbon", "CRSI", "Squeeze")
    variants = {"trail": {"trail": 30.0}, "limit": {"max_bars": 5}, "close": {"fill_next": False}, "cost": {"sl": 40.0, "tp": 80.0, "cost": 0.1}}
    made = [trd.backtest(s, **v).withColumn("variant", F.lit(n)) for n, v in variants.items()]
    t = made[0]
    for m in made[1:]:
        t = t.unionByName(m)
    return rounded(t.groupBy("variant", "rule", "exit_reason").agg(F.count(F.lit(1)).alias("n"), F.sum("net").alias("net")), 6)


@query(
    "SELECT cfg, count(*) AS n, count(*) FILTER (ret > 0) AS wins, count(*) FILTER (ret < 0) AS losses, round(avg(ret), 5) AS expectancy, round(avg(ret) FILTER (ret > 0), 5) AS avg_win, round(avg(ret) FILTER (ret < 0), 5) AS avg_loss, round(sum(ret) FILTER (ret > 0) / -sum(ret) FILTER (ret < 0), 5) AS profit_factor, round(avg(ret) / stddev_samp(ret) * sqrt(count(*)), 5) AS trade_sharpe, round(avg(ret) / stddev_samp(ret) FILTER (ret < 0), 5) AS sortino, round(max(greatest(top, 0) - e), 4) AS max_drawdown, max(ret) AS best, min(ret) AS worst FROM (SELECT *, max(e) OVER (PARTITION BY cfg ORDER BY seq ROWS UNBOUNDED PRECEDING) AS top FROM (SELECT *, sum(ret) OVER (PARTITION BY cfg ORDER BY seq ROWS UNBOUNDED PRECEDING) AS e FROM trades)) GROUP BY cfg",
    TRADES_SQL,
)
def trade_metrics(spark, sf_dir):
    m = trd.trade_metrics(trades(spark, sf_dir), "cfg", "ret", "seq")
    # returns have four digits, so at four a sum has no tie to round
    return rounded(m.withColumn("max_drawdown", F.round("max_drawdown", 4)))


@query("SELECT cfg, count(*) AS days, round(avg(d) / stddev_samp(d) * sqrt(252), 5) AS daily_sharpe FROM (SELECT cfg, day, sum(ret) AS d FROM trades GROUP BY ALL) GROUP BY cfg", TRADES_SQL)
def daily_sharpe(spark, sf_dir):
    return rounded(trd.daily_sharpe(trades(spark, sf_dir), "cfg", "ret", "day"))


@query(
    "SELECT cfg, " + ", ".join(f"round(sum(ret) FILTER (k <= {k}) / sum(ret), 5) AS top{k}" for k in (1, 5, 10)) + ", round(avg(ret) FILTER (k > 5), 5) AS mean_without_best5 FROM (SELECT *, row_number() OVER (PARTITION BY cfg ORDER BY ret DESC, seq) AS k FROM trades) GROUP BY cfg",
    TRADES_SQL,
)
def trade_concentration(spark, sf_dir):
    return rounded(trd.concentration(trades(spark, sf_dir), "cfg", "ret", "seq"))


@query(
    "SELECT cfg, max(n) FILTER (s > 0) AS max_wins, max(n) FILTER (s < 0) AS max_losses FROM (SELECT cfg, run, s, count(*) AS n FROM (SELECT *, sum(c) OVER (PARTITION BY cfg ORDER BY seq) AS run FROM (SELECT cfg, seq, sign(ret) AS s, CASE WHEN sign(ret) = lag(sign(ret)) OVER (PARTITION BY cfg ORDER BY seq) THEN 0 ELSE 1 END AS c FROM trades)) GROUP BY ALL) GROUP BY cfg",
    TRADES_SQL,
)
def trade_streaks(spark, sf_dir):
    return trd.streak_stats(trades(spark, sf_dir), "cfg", "ret", "seq")


@query("SELECT cfg, round(corr(ret, b), 5) AS autocorrelation FROM (SELECT *, lag(ret) OVER (PARTITION BY cfg ORDER BY seq) AS b FROM trades) GROUP BY cfg", TRADES_SQL)
def trade_clustering(spark, sf_dir):
    return rounded(trd.clustering(trades(spark, sf_dir), "cfg", "ret", "seq"))


@query(
    "SELECT cfg, count(*) AS n, round(avg(ret), 5) AS mean, round(any_value(sd), 5) AS sd, round(avg(((ret - m) / sd) ** 3), 5) AS skew, round(avg(((ret - m) / sd) ** 4), 5) AS kurtosis, " + ", ".join(f"round(quantile_cont(ret, {q}), 8) AS p{int(q * 100)}" for q in (0.05, 0.25, 0.5, 0.75, 0.95)) + " FROM (SELECT *, avg(ret) OVER (PARTITION BY cfg) AS m, stddev_samp(ret) OVER (PARTITION BY cfg) AS sd FROM trades) GROUP BY cfg",
    TRADES_SQL,
)
def trade_distribution(spark, sf_dir):
    d = trd.distribution(trades(spark, sf_dir), "cfg", "ret")
    return d.select("cfg", "n", *[F.round(c, 5).alias(c) for c in ("mean", "sd", "skew", "kurtosis")], *[F.round(c, 8).alias(c) for c in d.columns if c.startswith("p")])


@query("SELECT cfg, year, count(*) AS n, round(avg(ret), 5) AS mean, round(avg(CASE WHEN ret > 0 THEN 1.0 ELSE 0.0 END), 5) AS win_rate, CASE WHEN count(*) < 10 THEN 'INSUFFICIENT' WHEN count(*) < 30 THEN 'EXPLORATORY' ELSE 'RANKABLE' END AS tier FROM (SELECT *, CAST(year(day) AS INT) AS year FROM trades) GROUP BY CUBE (cfg, year)", TRADES_SQL)
def profile_cube(spark, sf_dir):
    return rounded(trd.profile_cells(trades(spark, sf_dir).withColumn("year", F.year("day")), ["cfg", "year"], "ret"))


@query("SELECT cfg, round(low, 6) AS low, round(high, 6) AS high FROM (SELECT cfg, (p + z * z / (2 * n) - z * sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n) AS low, (p + z * z / (2 * n) + z * sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n) AS high FROM (SELECT cfg, CAST(1.96 AS DOUBLE) AS z, CAST(count(*) AS DOUBLE) AS n, count(*) FILTER (ret > 0) / count(*) AS p FROM trades GROUP BY cfg))", TRADES_SQL)
def win_rate_interval(spark, sf_dir):
    m = trades(spark, sf_dir).groupBy("cfg").agg(F.count_if(F.col("ret") > 0).cast("double").alias("k"), F.count(F.lit(1)).cast("double").alias("n"))
    low, high = trd.wilson(F.col("k"), F.col("n"))
    return rounded(m.select("cfg", low.alias("low"), high.alias("high")), 6)


_YEARS_SQL = "m AS (SELECT cfg || '-' || CAST(year(day) AS VARCHAR) AS cfg, count(*) AS n, avg(ret) AS e, stddev_samp(ret) AS sd FROM trades GROUP BY 1)"


def _years(spark, sf_dir):
    t = trades(spark, sf_dir).withColumn("cfg", F.concat_ws("-", "cfg", F.year("day").cast("string")))
    return t.groupBy("cfg").agg(F.count(F.lit(1)).alias("n"), F.avg("ret").alias("expectancy"), F.stddev_samp("ret").alias("sd"))


@query("SELECT cfg, n, CAST(row_number() OVER (ORDER BY e DESC, n DESC, cfg) AS INT) AS rank FROM m", TRADES_SQL, _YEARS_SQL)
def ranked_board(spark, sf_dir):
    return trd.board(_years(spark, sf_dir)).select("cfg", "n", "rank")


@query("SELECT cfg, n FROM m a WHERE NOT EXISTS (SELECT 1 FROM m b WHERE b.e >= a.e AND b.n >= a.n AND b.sd <= a.sd AND (b.e > a.e OR b.n > a.n OR b.sd < a.sd))", TRADES_SQL, _YEARS_SQL)
def pareto_frontier(spark, sf_dir):
    return trd.pareto(_years(spark, sf_dir), ["expectancy", "n"], ["sd"]).select("cfg", "n")


# --- inference -------------------------------------------------------------------------------------------------------


@query(
    "SELECT name, round(p, 6) AS p, round(least(1, min(p * n / k) OVER (ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)), 6) AS bh, round(max(least(1, p * (n - k + 1))) OVER (ORDER BY k), 6) AS holm, round(least(1, p * n), 6) AS bonferroni FROM (SELECT cfg AS name, p, row_number() OVER (ORDER BY p, cfg) AS k, count(*) OVER () AS n FROM (SELECT cfg, round(1 / (1 + n * abs(e)), 6) AS p FROM m))",
    TRADES_SQL,
    _YEARS_SQL,
)
def multiple_testing(spark, sf_dir):
    p = _years(spark, sf_dir).select(F.col("cfg").alias("name"), F.round(1 / (1 + F.col("n") * F.abs("expectancy")), 6).alias("p"))
    return rounded(inf.adjust(p), 6)


@query(
    "SELECT cfg, count(*) AS n, round(any_value(m / sd), 6) AS sr, round(avg(((ret - m) / sd) ** 3), 6) AS skew, round(avg(((ret - m) / sd) ** 4), 6) AS kurt FROM (SELECT *, avg(ret) OVER (PARTITION BY cfg) AS m, stddev_samp(ret) OVER (PARTITION BY cfg) AS sd FROM trades) GROUP BY cfg",
    TRADES_SQL,
)
def sharpe_moments(spark, sf_dir):
    return rounded(inf.moments(trades(spark, sf_dir), "cfg", "ret"), 6)


@query()
def deflated_sharpe(spark, sf_dir):
    return rounded(inf.deflated_sharpe(trades(spark, sf_dir), "cfg", "ret", 42, 0.0004), 6)


_DAYS_SQL = "d AS (SELECT day, row_number() OVER (ORDER BY day) - 1 AS pos, count(*) OVER () AS n FROM (SELECT DISTINCT day FROM trades))"


@query("SELECT day, CASE WHEN pos < floor(n * CAST(0.5 AS DOUBLE)) THEN 'train' WHEN pos < floor(n * CAST(0.5 AS DOUBLE)) + 1 THEN 'embargo' WHEN pos < floor(n * CAST(0.7 AS DOUBLE)) THEN 'validation' WHEN pos < floor(n * CAST(0.7 AS DOUBLE)) + 1 THEN 'embargo' ELSE 'test' END AS part FROM d", TRADES_SQL, _DAYS_SQL)
def chronological_splits(spark, sf_dir):
    return inf.splits(trades(spark, sf_dir).select("day").distinct())


@query("SELECT fold, day, role FROM (SELECT CAST(f AS INT) AS fold, day, CASE WHEN pos < f * floor(n / 5) - 1 THEN 'train' WHEN pos >= f * floor(n / 5) + 1 AND pos < (f + 1) * floor(n / 5) THEN 'test' END AS role FROM d, (SELECT unnest(range(1, 5)) AS f)) WHERE role IS NOT NULL", TRADES_SQL, _DAYS_SQL)
def purged_folds(spark, sf_dir):
    return inf.purged_folds(trades(spark, sf_dir).select("day").distinct())


@query()
def permutation_null(spark, sf_dir):
    f = ser.labels(ser.returns(bars(spark, sf_dir)), (1,)).where("fwd_ret_1 is not null")
    e = f.select(F.col("symbol").alias("name"), F.to_date("ts").cast("string").alias("block"), F.col("fwd_ret_1").alias("label"), F.coalesce(F.col("return_1") > 50, F.lit(False)).alias("event"), "ts")
    from pyspark.sql import Window

    e = e.withColumn("pos", F.row_number().over(Window.partitionBy("name", "block").orderBy("ts")) - 1).drop("ts")
    return rounded(inf.permutation_null(e, 100), 6)


@query()
def bootstrap_interval(spark, sf_dir):
    return inf.bootstrap_ci(trades(spark, sf_dir), "cfg", "ret")


@query(
    "SELECT feature, symbol, count(*) AS n, round(corr(x, y), 5) AS ic FROM (SELECT 'return_1' AS feature, symbol, return_1 AS x, fwd_ret_1 AS y FROM lab UNION ALL SELECT 'return_5', symbol, return_5, fwd_ret_1 FROM lab) WHERE x IS NOT NULL AND y IS NOT NULL GROUP BY GROUPING SETS ((feature, symbol), (feature))",
    BARS_SQL,
    RETURNS_SQL,
    LABELS_SQL,
)
def information_coefficients(spark, sf_dir):
    return rounded(inf.information_coefficient(ser.labels(ser.returns(bars(spark, sf_dir)), (1,)), ["return_1", "return_5"], "fwd_ret_1", "symbol"))


@query(
    "SELECT name, part, count(*) AS n, round(avg(y), 4) AS mean, round(avg(CASE WHEN y > 0 THEN 1.0 ELSE 0.0 END), 4) AS win_rate FROM ("
    + " UNION ALL ".join(f"SELECT '{n}' AS name, CASE WHEN day(ts) <= 15 THEN 'train' ELSE 'test' END AS part, fwd_ret_1 AS y FROM lab WHERE fwd_ret_1 IS NOT NULL AND {m}" for n, m in (("up", "return_1 > 50"), ("down", "return_1 < -50"), ("both", "return_1 > 50 AND return_5 < 0")))
    + ") GROUP BY ALL",
    BARS_SQL,
    RETURNS_SQL,
    LABELS_SQL,
)
def hypothesis_round(spark, sf_dir):
    up, down = {"kind": "atomic", "col": "return_1", "op": "gt", "val": 50.0}, {"kind": "atomic", "col": "return_1", "op": "lt", "val": -50.0}
    both = {"kind": "combo", "parent": up, "leg": {"kind": "atomic", "col": "return_5", "op": "lt", "val": 0.0}}
    masks = {n: inf.compile_recipe(x) for n, x in (("up", up), ("down", down), ("both", both))}
    frame = ser.labels(ser.returns(bars(spark, sf_dir)), (1,))
    return rounded(inf.hypotheses(frame, masks, "fwd_ret_1", F.when(F.dayofmonth("ts") <= 15, "train").otherwise("test")), 4)


@query("SELECT a.x AS timeframe, b.x AS sl, c.x AS tp, 'timeframe=' || a.x || '|sl=' || b.x || '|tp=' || c.x AS cfg FROM (SELECT unnest([1, 5, 15]) AS x) a, (SELECT unnest([1, 2]) AS x) b, (SELECT unnest([1, 2, 3]) AS x) c")
def parameter_grid(spark, sf_dir):
    return inf.grid(spark, {"timeframe": [1, 5, 15], "sl": [1, 2], "tp": [1, 2, 3]})


# --- long-premium rules ----------------------------------------------------------------------------------------------

_MINUTES_SQL = BARS_SQL.replace("'hour'", "'minute'")
_SESSION = "PARTITION BY symbol, day ORDER BY ts"
_FEATURES_SQL = (
    "f1 AS (SELECT *, CAST(ts AS DATE) AS day, (high + low + close) / 3 AS tp FROM bars)",
    f"f2 AS (SELECT *, coalesce(sum(tp * volume) OVER s / nullif(sum(volume) OVER s, 0), tp) AS vwap, greatest(abs(high - low), abs(high - lag(close) OVER d), abs(low - lag(close) OVER d)) AS true_range, abs(close - lag(close) OVER d) AS moved, lag(close, 30) OVER d AS earlier FROM f1 WINDOW s AS ({_SESSION} ROWS UNBOUNDED PRECEDING), d AS ({_SESSION}))",
    f"f3 AS (SELECT *, abs(close - vwap) AS vwap_dev, CASE WHEN close > 0 AND count(high) OVER w >= 5 THEN (max(high) OVER w - min(low) OVER w) / close * 100 END AS range_pct FROM f2 WINDOW w AS ({_SESSION} ROWS 19 PRECEDING))",
    f"f4 AS (SELECT *, CASE WHEN count(vwap_dev) OVER w60 >= 20 THEN stddev_samp(vwap_dev) OVER w60 END AS vwap_sigma, CASE WHEN count(volume) OVER w20 >= 5 THEN quantile_cont(volume, 0.5) OVER w20 END AS vol_med, CASE WHEN count(true_range) OVER w20 >= 5 AND close > 0 THEN avg(true_range) OVER w20 / close * 100 END AS atr_pct, list(range_pct) OVER w120 AS ranges, list(volume) OVER w120 AS volumes, CASE WHEN count(moved) OVER w30 >= 5 THEN sum(moved) OVER w30 END AS path, CASE WHEN count(high) OVER ago >= 10 THEN max(high) OVER ago END AS swing_high, CASE WHEN count(low) OVER ago >= 10 THEN min(low) OVER ago END AS swing_low FROM f3 WINDOW w20 AS ({_SESSION} ROWS 19 PRECEDING), w30 AS ({_SESSION} ROWS 29 PRECEDING), w60 AS ({_SESSION} ROWS 59 PRECEDING), w120 AS ({_SESSION} ROWS 119 PRECEDING), ago AS ({_SESSION} ROWS BETWEEN 31 PRECEDING AND 2 PRECEDING))",
    "f5 AS (SELECT *, CASE WHEN vwap_sigma > 0 THEN vwap_dev / vwap_sigma END AS vwap_z, CASE WHEN len(list_filter(ranges, lambda x: x IS NOT NULL)) >= 30 THEN len(list_filter(ranges, lambda x: x <= range_pct)) * CAST(100 AS DOUBLE) / len(list_filter(ranges, lambda x: x IS NOT NULL)) END AS range_pctile, CASE WHEN vol_med > 0 THEN volume / vol_med END AS vol_ratio, CASE WHEN len(volumes) >= 20 THEN len(list_filter(volumes, lambda x: x <= volume)) * CAST(100 AS DOUBLE) / len(volumes) END AS vol_pctile, abs(close - earlier) / nullif(path, 0) AS eff_ratio FROM f4)",
    "f6 AS (SELECT *, CASE WHEN eff_ratio IS NULL OR range_pctile IS NULL THEN 'UNKNOWN' WHEN eff_ratio >= CAST(0.45 AS DOUBLE) THEN 'TRENDING' WHEN range_pctile >= 70 THEN 'CHOPPY' ELSE 'COMPRESSING' END AS regime FROM f5)",
)
_MEANS = ("vwap", "vwap_dev", "range_pct", "atr_pct")
_SHOWN = ("true_range", "vwap_sigma", "vwap_z", "range_pctile", "vol_med", "vol_ratio", "vol_pctile", "eff_ratio", "swing_high", "swing_low")


@query(f"SELECT symbol, ts, {r(*_MEANS, digits=9)}, {r(*_SHOWN, digits=4)} FROM f5", _MINUTES_SQL, *_FEATURES_SQL[:5])
def buyonly_features(spark, sf_dir):
    f = buy.session_features(bars(spark, sf_dir, "minute"))
    # means of two-digit prices are often half a fourth digit
    return f.select("symbol", "ts", *[(F.round(c, 9) + 0.0).alias(c) for c in _MEANS], *[(F.round(c, 4) + 0.0).alias(c) for c in _SHOWN])


@query("SELECT symbol, regime, count(*) AS n FROM f6 GROUP BY ALL", _MINUTES_SQL, *_FEATURES_SQL)
def buyonly_regimes(spark, sf_dir):
    return buy.regimes(buy.session_features(bars(spark, sf_dir, "minute"))).groupBy("symbol", "regime").agg(F.count(F.lit(1)).alias("n"))


@query(
    "SELECT symbol, ts, hypothesis, direction, high, low, close FROM ("
    "SELECT *, 'VOLATILITY_COIL' AS hypothesis, CASE WHEN armed AND close > ch1 THEN 'CE' WHEN armed AND close < cl1 THEN 'PE' END AS direction FROM g2 UNION ALL "
    "SELECT *, 'LIQUIDITY_FLUSH', CASE WHEN low < swing_low AND close > sl1 AND bull AND vol_ratio >= CAST(1.8 AS DOUBLE) THEN 'CE' WHEN high > swing_high AND close < sh1 AND bear AND vol_ratio >= CAST(1.8 AS DOUBLE) THEN 'PE' END FROM g2 UNION ALL "
    "SELECT *, 'VWAP_SNAP_BACK', CASE WHEN vwap_z >= 2 AND close < vwap AND bull THEN 'CE' WHEN vwap_z >= 2 AND close > vwap AND bear THEN 'PE' END FROM g2) WHERE direction IS NOT NULL",
    _MINUTES_SQL,
    *_FEATURES_SQL,
    f"g1 AS (SELECT *, CASE WHEN count(high) OVER w >= 5 THEN max(high) OVER w END AS coil_high, CASE WHEN count(low) OVER w >= 5 THEN min(low) OVER w END AS coil_low, lag(swing_low) OVER d AS sl1, lag(swing_high) OVER d AS sh1, low < lag(low) OVER d AND close > greatest(open, (high + low) / 2, lag(close) OVER d) AS bull, high > lag(high) OVER d AND close < least(open, (high + low) / 2, lag(close) OVER d) AS bear FROM f6 WINDOW w AS ({_SESSION} ROWS 19 PRECEDING), d AS ({_SESSION}))",
    f"g2 AS (SELECT *, lag(coil_high) OVER d AS ch1, lag(coil_low) OVER d AS cl1, range_pctile <= 30 AND vol_ratio >= 2 AND lag(coil_high) OVER d - lag(coil_low) OVER d < lag(coil_high, 4) OVER d - lag(coil_low, 4) OVER d AS armed FROM g1 WINDOW d AS ({_SESSION}))",
)
def buyonly_signals(spark, sf_dir):
    return buy.detect(buy.session_features(bars(spark, sf_dir, "minute")))


@query(
    "SELECT symbol, ts, entry, arg_min(bar_ts, nth) AS exit_ts, round(arg_min(price, nth), 6) AS exit, arg_min(reason, nth) AS exit_reason, CAST(min(nth) - any_value(a) AS INT) AS held, round(arg_min(price, nth) - entry, 6) AS points FROM (SELECT *, CASE reason WHEN 'STOP_GAP' THEN open WHEN 'STOP' THEN stop WHEN 'TARGET' THEN goal ELSE close END AS price FROM (SELECT *, CASE WHEN open < stop THEN 'STOP_GAP' WHEN low <= stop THEN 'STOP' WHEN high >= goal THEN 'TARGET' WHEN nth = a + 45 THEN 'TIME' WHEN nth = last THEN 'END_OF_DAY' END AS reason FROM p4) WHERE reason IS NOT NULL) GROUP BY symbol, ts, entry",
    _MINUTES_SQL,
    "p1 AS (SELECT *, CAST(ts AS DATE) AS day, row_number() OVER (PARTITION BY symbol, CAST(ts AS DATE) ORDER BY ts) AS nth, count(*) OVER (PARTITION BY symbol, CAST(ts AS DATE)) AS last FROM bars)",
    "p2 AS (SELECT a.symbol, a.ts, a.low AS trigger_low, a.nth AS a, b.ts AS bar_ts, b.nth, b.last, b.open, b.high, b.low, b.close, first(b.open) OVER (PARTITION BY a.symbol, a.ts ORDER BY b.nth) AS entry FROM p1 a JOIN p1 b ON a.symbol = b.symbol AND a.day = b.day AND b.nth > a.nth AND b.nth <= a.nth + 45 WHERE minute(a.ts) % 7 = 0)",
    "p3 AS (SELECT *, greatest(entry - trigger_low + 1, 30) AS risk, coalesce(max(high) OVER (PARTITION BY symbol, ts ORDER BY nth ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), entry) - entry AS seen FROM p2)",
    "p3a AS (SELECT *, min(CASE WHEN high - entry >= risk THEN nth END) OVER (PARTITION BY symbol, ts) AS paid FROM p3)",
    "p3b AS (SELECT *, max(CASE WHEN nth = paid THEN high - entry END) OVER (PARTITION BY symbol, ts) AS gain, lag(low) OVER (PARTITION BY symbol, ts ORDER BY nth) AS low1 FROM p3a)",
    "p3c AS (SELECT *, greatest(CASE WHEN seen >= CAST(2.5 AS DOUBLE) THEN entry ELSE entry - risk END, CASE WHEN nth > paid THEN entry + CAST(0.5 AS DOUBLE) * gain END) AS base FROM p3b)",
    "p4 AS (SELECT *, greatest(base, max(CASE WHEN base >= entry THEN low1 END) OVER (PARTITION BY symbol, ts ORDER BY nth ROWS UNBOUNDED PRECEDING)) AS stop, entry + 2 * risk AS goal FROM p3c)",
)
def buyonly_exits(spark, sf_dir):
    b = bars(spark, sf_dir, "minute")
    x = buy.exits(b.where(F.minute("ts") % 7 == 0), b)
    return x.select("symbol", "ts", "entry", "exit_ts", F.round("exit", 6).alias("exit"), "exit_reason", "held", F.round("points", 6).alias("points"))


_WALLS_SQL = (
    "spot AS (SELECT ts, sum(strike * volume) / sum(volume) AS close FROM chain GROUP BY ts)",
    "held AS (SELECT option_type, ts, strike, CASE WHEN count(oi) OVER w >= 5 THEN max(oi) OVER w END AS held FROM (SELECT option_type, ts, strike, sum(oi) AS oi FROM chain GROUP BY ALL) WINDOW w AS (PARTITION BY option_type, strike ORDER BY ts ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING))",
    "walls AS (SELECT option_type, ts, arg_max(strike, (held, -strike)) FILTER (held IS NOT NULL) AS wall, max(held) AS wall_oi FROM held GROUP BY ALL)",
    "moves AS (SELECT *, lag(wall) OVER l AS last_wall, lag(wall_oi, 5) OVER l AS earlier FROM walls WINDOW l AS (PARTITION BY option_type ORDER BY ts))",
)


@query(
    "SELECT direction, count(*) AS n, min(ts) AS first_ts, max(ts) AS last_ts FROM (SELECT ts, CASE WHEN option_type = 'CE' AND close + 50 > last_wall THEN 'CE' WHEN option_type = 'PE' AND close - 50 < last_wall THEN 'PE' END AS direction FROM moves JOIN spot USING (ts) WHERE wall <> last_wall AND (earlier - wall_oi) / earlier * 100 >= 8) WHERE direction IS NOT NULL GROUP BY direction",
    CHAIN_SQL,
    *_WALLS_SQL,
)
def buyonly_oi_walls(spark, sf_dir):
    c = chain(spark, sf_dir)
    spot = c.groupBy("ts").agg((F.sum(F.col("strike") * F.col("volume")) / F.sum("volume")).alias("close"))
    spot = spot.select(F.lit("SPOT").alias("symbol"), "ts", (F.col("close") + 50).alias("high"), (F.col("close") - 50).alias("low"), "close")
    s = buy.oi_velocity(spot, c)
    return s.groupBy("direction").agg(F.count(F.lit(1)).alias("n"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))


# --- premium and events ----------------------------------------------------------------------------------------------

_FLAGS = ("premium_shock", "premium_mean_reversion", "alternating", "premium_breakout", "premium_expansion", "volume_persistence")
_PREMIUM_SQL = (
    f"q1 AS (SELECT *, return_1 - return_3 AS accel_1_3, abs(return_1) AS size, lag(return_1) {_W}) AS b1, lag(return_1, 2) {_W}) AS b2, (high - low) / nullif(lag(high - low) {_W}), 0) AS range_ratio FROM ret)",
    f"q2 AS (SELECT *, accel_1_3 - lag(accel_1_3) {_W}) AS premium_accel, count(size) OVER p AS k, list(size) OVER p AS sizes, avg(size) OVER p AS m, stddev_pop(size) OVER p AS sd, CASE WHEN count(volume) OVER p >= 20 THEN volume / nullif(quantile_cont(volume, 0.5) OVER p, 0) END AS volume_ratio FROM q1 WINDOW p AS (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 120 PRECEDING AND 1 PRECEDING))",
    f"q3 AS (SELECT *, count(*) FILTER (NOT coalesce(volume_ratio > CAST(1.2 AS DOUBLE), false)) {_W}) AS island FROM q2)",
)


@query(
    "SELECT symbol, ts, round(volume_ratio, 4) AS volume_ratio, round(premium_accel, 4) + 0.0 AS premium_accel, round(CASE WHEN k >= 20 AND size IS NOT NULL THEN len(list_filter(sizes, lambda x: x <= size)) * CAST(100 AS DOUBLE) / k END, 4) AS premium_percentile, round(CASE WHEN k >= 20 THEN (size - m) / nullif(sd, 0) END, 4) + 0.0 AS premium_zscore, CAST(coalesce(size > 3, false) AS INT) AS premium_shock, CAST(coalesce(return_1 * b1 < 0 AND abs(b1) > 1, false) AS INT) AS premium_mean_reversion, CAST(coalesce((return_1 > 0) <> (b1 > 0) AND (b1 > 0) <> (b2 > 0), false) AS INT) AS alternating, CAST(coalesce(range_ratio > 2 AND abs(return_5) > CAST(1.5 AS DOUBLE), false) AS INT) AS premium_breakout, CAST(coalesce(range_ratio > 2, false) AS INT) AS premium_expansion, CASE WHEN volume_ratio > CAST(1.2 AS DOUBLE) THEN count(*) FILTER (volume_ratio > CAST(1.2 AS DOUBLE)) OVER (PARTITION BY symbol, island ORDER BY ts) ELSE 0 END AS volume_persistence FROM q3",
    BARS_SQL,
    RETURNS_SQL,
    *_PREMIUM_SQL,
)
def premium_features(spark, sf_dir):
    f = prm.premium_features(ser.returns(bars(spark, sf_dir)))
    return rounded(f.select("symbol", "ts", "volume_ratio", "premium_accel", "premium_percentile", "premium_zscore", *_FLAGS), 4)


@query(
    "SELECT symbol, CAST(sum(CAST(coalesce(b > 50 AND abs(s) < b, false) AS INT)) AS BIGINT) AS converged, CAST(sum(CAST(coalesce(abs(s) >= 50, false) AS INT)) AS BIGINT) AS setups FROM (SELECT symbol, return_1 - return_3 AS s, abs(lag(return_1 - return_3) OVER (PARTITION BY symbol ORDER BY ts)) AS b FROM ret) GROUP BY symbol",
    BARS_SQL,
    RETURNS_SQL,
)
def convergence_events(spark, sf_dir):
    f = prm.catchup(prm.convergence(ser.returns(bars(spark, sf_dir)), ["accel_1_3"], 50.0), ["accel_1_3"], 50.0)
    return f.groupBy("symbol").agg(F.sum(F.col("ev_convergence").cast("long")).alias("converged"), F.sum(F.col("ev_catchup_setup").cast("long")).alias("setups"))


@query(
    "SELECT count(*) AS n, round(avg(CASE WHEN y > CAST(0.5 AS DOUBLE) THEN 1.0 ELSE 0.0 END), 6) AS catch_up, round(avg(CASE WHEN abs(y) <= CAST(0.5 AS DOUBLE) THEN 1.0 ELSE 0.0 END), 6) AS keeps_lagging, round(avg(CASE WHEN y < CAST(-0.5 AS DOUBLE) THEN 1.0 ELSE 0.0 END), 6) AS reversal FROM (SELECT fwd_ret_5 AS y FROM lab WHERE return_1 > 50 AND fwd_ret_5 IS NOT NULL)",
    BARS_SQL,
    RETURNS_SQL,
    LABELS_SQL,
)
def catchup_outcomes(spark, sf_dir):
    return rounded(prm.catchup_outcomes(ser.labels(ser.returns(bars(spark, sf_dir)), (5,)), F.col("return_1") > 50, "fwd_ret_5"), 6)


@query(
    "SELECT option_type, count(*) AS n, CAST(sum(CAST(coalesce(pct >= 95, false) AS INT)) AS BIGINT) AS shocks, round(avg(pct), 6) AS mean_rank FROM (SELECT option_type, CASE WHEN k >= 20 AND b IS NOT NULL THEN len(list_filter(l, lambda x: x <= b)) * CAST(100 AS DOUBLE) / k END AS pct FROM (SELECT option_type, lag(oi) OVER s AS b, list(oi) OVER p AS l, count(oi) OVER p AS k FROM chain WINDOW s AS (PARTITION BY symbol ORDER BY ts), p AS (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 120 PRECEDING AND 1 PRECEDING))) GROUP BY option_type",
    CHAIN_SQL,
)
def oi_shocks(spark, sf_dir):
    f = prm.oi_shocks(chain(spark, sf_dir))
    return rounded(f.groupBy("option_type").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("e_oi_shock").cast("long")).alias("shocks"), F.avg("oi_percentile").alias("mean_rank")), 6)


@query(
    "SELECT cfg, " + ", ".join(f"round(sum(abs(ret)) FILTER (k <= greatest(1, ceil(n * CAST({s} AS DOUBLE)))) / sum(abs(ret)), 6) AS top{round(s * 100)}pct" for s in (0.01, 0.05, 0.1)) + " FROM (SELECT *, row_number() OVER (PARTITION BY cfg ORDER BY abs(ret) DESC, seq) AS k, count(*) OVER (PARTITION BY cfg) AS n FROM trades) GROUP BY cfg",
    TRADES_SQL,
)
def trade_top_share(spark, sf_dir):
    return rounded(prm.top_share(trades(spark, sf_dir), "cfg", "ret"), 6)


@query()
def sign_flip_test(spark, sf_dir):
    return rounded(prm.sign_flip_test(trades(spark, sf_dir), "cfg", "ret", "seq"), 6)


# --- validation ------------------------------------------------------------------------------------------------------


@query(
    "SELECT cfg, count(*) AS folds, count(*) FILTER (n >= 50) AS live_folds, count(*) FILTER (n >= 50 AND e > 0) AS win_folds, round(count(*) FILTER (n >= 50 AND e > 0) / nullif(count(*) FILTER (n >= 50), 0), 6) AS fold_win_rate, count(*) - count(*) FILTER (n >= 50) AS thin_folds FROM (SELECT cfg, year(day) AS y, count(*) AS n, avg(ret) AS e FROM trades GROUP BY ALL) GROUP BY cfg",
    TRADES_SQL,
)
def fold_stability(spark, sf_dir):
    folds = trades(spark, sf_dir).groupBy("cfg", F.year("day").alias("y")).agg(F.count(F.lit(1)).alias("n"), F.avg("ret").alias("expectancy"))
    return rounded(gat.fold_stability(folds, "cfg", 50), 6)


_PVALUES_SQL = "pv AS (SELECT cfg AS name, left(cfg, 1) AS family, round(1 / (1 + n * abs(e)), 6) AS p FROM m)"
_BH = "least(1, min(p * n / k) OVER (ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))"


@query(
    "SELECT name, family, p, round(a, 6) AS p_adj, round(fa, 6) AS family_p_adj, fa < CAST(0.1 AS DOUBLE) AND a < CAST(0.1 AS DOUBLE) AS passed FROM adj JOIN fam USING (family)",
    TRADES_SQL,
    _YEARS_SQL,
    _PVALUES_SQL,
    f"adj AS (SELECT name, family, p, {_BH} AS a FROM (SELECT *, row_number() OVER (ORDER BY p, name) AS k, count(*) OVER () AS n FROM pv))",
    f"fam AS (SELECT family, {_BH} AS fa FROM (SELECT *, row_number() OVER (ORDER BY p, family) AS k, count(*) OVER () AS n FROM (SELECT family, min(p) AS p FROM pv GROUP BY family)))",
)
def hierarchical_fdr(spark, sf_dir):
    p = _years(spark, sf_dir).select(F.col("cfg").alias("name"), F.substring("cfg", 1, 1).alias("family"), F.round(1 / (1 + F.col("n") * F.abs("expectancy")), 6).alias("p"))
    return rounded(gat.hierarchical_fdr(p), 6)


#: one candidate for each priority and year, with stand-ins for what earlier stages would have measured
_CANDIDATES_SQL = "cand AS (SELECT cfg, n AS events, CAST(n % 9 AS INT) AS days, round(e, 6) AS FWD_expectancy, round(e - CAST(0.02 AS DOUBLE), 6) AS FWD_IS_expectancy, round(e + CAST(0.01 AS DOUBLE), 6) AS IS_expectancy, n % 5 = 0 AS exit_cap_dominated, CAST(n % 11 AS DOUBLE) AS robustness_score, CASE WHEN n % 3 > 0 THEN 'OOS_TRADING_RULE_PASS' ELSE 'OOS_FAIL' END AS OOS_trading_result, CASE WHEN n % 2 = 0 THEN 'EXECUTABLE_PRICE_MODEL' ELSE 'MID' END AS execution_model, n % 4 > 0 AS mt_pass, n % 2 = 0 AS paper_eligible, round(CAST(n % 20 AS DOUBLE) / 100, 6) AS p_adj, round(CAST(n % 13 AS DOUBLE) / 20, 6) AS top5, CASE WHEN n % 17 < 3 THEN 'THIN_OOS' ELSE 'OOS_OK' END AS oos_gate FROM m)"


def _candidates(spark, sf_dir):
    n, e = F.col("n"), F.col("expectancy")
    return _years(spark, sf_dir).select(
        "cfg",
        n.alias("events"),
        (n % 9).cast("int").alias("days"),
        F.round(e, 6).alias("FWD_expectancy"),
        F.round(e - 0.02, 6).alias("FWD_IS_expectancy"),
        F.round(e + 0.01, 6).alias("IS_expectancy"),
        (n % 5 == 0).alias("exit_cap_dominated"),
        (n % 11).cast("double").alias("robustness_score"),
        F.when(n % 3 > 0, "OOS_TRADING_RULE_PASS").otherwise("OOS_FAIL").alias("OOS_trading_result"),
        F.when(n % 2 == 0, "EXECUTABLE_PRICE_MODEL").otherwise("MID").alias("execution_model"),
        (n % 4 > 0).alias("mt_pass"),
        (n % 2 == 0).alias("paper_eligible"),
        F.round((n % 20).cast("double") / 100, 6).alias("p_adj"),
        F.round((n % 13).cast("double") / 20, 6).alias("top5"),
        F.when(n % 17 < 3, "THIN_OOS").otherwise("OOS_OK").alias("oos_gate"),
    )


@query(
    "SELECT cfg, fails_at, CASE WHEN k = 9 THEN 'EXECUTABLE_EDGE' WHEN k = 8 THEN 'VALIDATED_OOS_EDGE' WHEN k = 7 THEN 'ROBUST_EDGE_FOUND' WHEN k = 6 THEN 'TRADING_EDGE_FOUND' WHEN k = 5 THEN 'PREDICTIVE_INFORMATION_ONLY' WHEN k > 1 THEN 'PREDICTIVE_INFORMATION_FOUND' ELSE 'NO_INFORMATION' END AS edge_kind FROM (SELECT cfg, k, ['L1_FEATURE_INFORMATION', 'L2_EVENT_INFORMATION', 'L3_COMBINATION_INFORMATION', 'L4_RETURN_PREDICTION', 'L5_TRADING_RULE', 'L6_ROBUSTNESS', 'L7_OOS', 'L8_EXECUTION', 'NONE_ALL_PASS'][k] AS fails_at FROM (SELECT cfg, CASE WHEN NOT FWD_expectancy > 0 THEN 1 WHEN events < 50 THEN 2 WHEN NOT FWD_IS_expectancy > 0 THEN 4 WHEN exit_cap_dominated OR NOT IS_expectancy > 0 THEN 5 WHEN robustness_score < 4 THEN 6 WHEN OOS_trading_result = 'OOS_FAIL' THEN 7 WHEN execution_model = 'MID' THEN 8 ELSE 9 END AS k FROM cand))",
    TRADES_SQL,
    _YEARS_SQL,
    _CANDIDATES_SQL,
)
def edge_ladder(spark, sf_dir):
    return gat.edge_ladder(_candidates(spark, sf_dir)).select("cfg", "fails_at", "edge_kind")


@query(
    "SELECT cfg, category, CASE WHEN category = 'VALIDATED_EDGE' THEN category WHEN category = 'OOS_DISCOVERY' THEN 'PROMISING_OOS' WHEN category = 'ROBUST_DISCOVERY' THEN 'ROBUST_CANDIDATE' WHEN category = 'NO_DISCOVERY' THEN 'NO_FRONTIER' ELSE 'PROMISING_ENTRY' END AS bucket, CASE WHEN NOT FWD_expectancy > 0 THEN 'OOS_FAIL' WHEN events < 50 THEN 'OOS_RAW_POSITIVE' WHEN robustness_score < 4 THEN 'OOS_THRESHOLD_PASS' WHEN NOT mt_pass THEN 'OOS_ROBUST_PASS' WHEN paper_eligible THEN 'OOS_FINAL_SURVIVOR' ELSE 'OOS_MULTIPLE_TEST_PASS' END AS stage, CASE WHEN NOT FWD_expectancy > 0 THEN 'NO_SIGNAL_FOUND' WHEN NOT IS_expectancy > 0 THEN 'NO_SIGNAL_FOUND' WHEN OOS_trading_result = 'OOS_FAIL' THEN 'OOS_FAILED' WHEN robustness_score < 4 THEN 'ROBUSTNESS_FAILED' WHEN NOT mt_pass THEN 'MULTIPLE_TESTING_FAILED' WHEN execution_model = 'MID' THEN 'EXECUTION_FAILED' ELSE 'VALIDATED_EDGE' END AS state FROM (SELECT *, CASE WHEN NOT FWD_expectancy > 0 THEN 'NO_DISCOVERY' WHEN NOT FWD_IS_expectancy > 0 THEN 'INFORMATION_DISCOVERY' WHEN NOT IS_expectancy > 0 THEN 'PREDICTIVE_DISCOVERY' WHEN robustness_score < 4 THEN 'TRADING_RULE_DISCOVERY' WHEN OOS_trading_result = 'OOS_FAIL' THEN 'ROBUST_DISCOVERY' WHEN mt_pass AND execution_model <> 'MID' AND paper_eligible THEN 'VALIDATED_EDGE' ELSE 'OOS_DISCOVERY' END AS category FROM cand)",
    TRADES_SQL,
    _YEARS_SQL,
    _CANDIDATES_SQL,
)
def research_states(spark, sf_dir):
    c = _candidates(spark, sf_dir).withColumn("category", gat.discovery_category())
    robust, oos = F.col("robustness_score") >= 4, F.col("OOS_trading_result") == "OOS_TRADING_RULE_PASS"
    stage = gat.oos_stage(F.col("FWD_expectancy"), F.col("events"), 50, F.col("mt_pass"), robust, F.col("paper_eligible"))
    state = gat.candidate_state(F.col("FWD_expectancy") > 0, F.col("IS_expectancy") > 0, oos, robust, F.col("mt_pass"), F.col("execution_model") == "EXECUTABLE_PRICE_MODEL", F.lit(False))
    return c.select("cfg", "category", gat.frontier_bucket(F.col("category"), F.lit("")).alias("bucket"), stage.alias("stage"), state.alias("state"))


@query(
    "SELECT cfg, CASE WHEN events < 50 OR days < 3 OR oos_gate = 'THIN_OOS' THEN 'THIN_SAMPLE' WHEN FWD_IS_expectancy <= 0 THEN 'OOS_REJECTED' WHEN NOT IS_expectancy > 0 THEN 'REJECTED' WHEN p_adj >= CAST(0.1 AS DOUBLE) THEN 'SURROGATE_REJECTED' WHEN exit_cap_dominated THEN 'CAP_DOMINATED' WHEN top5 >= CAST(0.5 AS DOUBLE) THEN 'CONCENTRATED' WHEN days < 5 THEN 'THIN_SAMPLE' WHEN p_adj < CAST(0.05 AS DOUBLE) THEN 'OOS_SURVIVED' ELSE 'ROBUST' END AS status FROM cand",
    TRADES_SQL,
    _YEARS_SQL,
    _CANDIDATES_SQL,
)
def candidate_status(spark, sf_dir):
    s = gat.status(oos="FWD_IS_expectancy", train="IS_expectancy", capped="exit_cap_dominated")
    return _candidates(spark, sf_dir).select("cfg", s.alias("status"))


@query(
    "SELECT cfg, CASE WHEN d AND f AND o AND events >= 50 THEN CASE WHEN paper_eligible THEN 'PAPER' ELSE 'VALIDATED' END WHEN events >= 50 THEN 'LEAD' ELSE 'REJECTED' END AS tier, CAST(events < 50 AS INT) + CAST(NOT d AS INT) + CAST(NOT f AS INT) + CAST(NOT o AS INT) AS n_reasons FROM (SELECT *, 1 - p_adj >= CAST(0.95 AS DOUBLE) AS d, 1 - top5 >= CAST(0.6 AS DOUBLE) AS f, FWD_IS_expectancy > 0 AS o FROM cand)",
    TRADES_SQL,
    _YEARS_SQL,
    _CANDIDATES_SQL,
)
def discovery_tiers(spark, sf_dir):
    tier, reasons = gat.discovery_tier(1 - F.col("p_adj"), 1 - F.col("top5"), F.col("FWD_IS_expectancy"), F.col("events"), F.col("paper_eligible"))
    return _candidates(spark, sf_dir).select("cfg", tier.alias("tier"), F.size(reasons).alias("n_reasons"))


@query(
    "SELECT dimension, groups, positive, round(CASE WHEN groups >= 2 THEN positive / groups END, 6) AS positive_share, positive = 0 OR positive = groups AS sign_agreement, CASE WHEN groups < 2 THEN 'UNTESTABLE' WHEN 2 * positive >= groups THEN 'PASS' ELSE 'FAIL' END AS status FROM (SELECT dimension, count(*) AS groups, count(*) FILTER (n >= 5 AND m > 0) AS positive FROM (SELECT dimension, value, count(y) AS n, avg(y) AS m FROM (SELECT 'symbol' AS dimension, symbol AS value, y FROM ev UNION ALL SELECT 'hour', CAST(hour(ts) AS VARCHAR), y FROM ev UNION ALL SELECT 'day', CAST(CAST(ts AS DATE) AS VARCHAR), y FROM ev) GROUP BY ALL) GROUP BY dimension)",
    BARS_SQL,
    RETURNS_SQL,
    LABELS_SQL,
    "ev AS (SELECT symbol, ts, fwd_ret_5 AS y FROM lab WHERE return_1 > 0)",
)
def generalization(spark, sf_dir):
    e = ser.labels(ser.returns(bars(spark, sf_dir)), (5,)).where("return_1 > 0").withColumns({"hour": F.hour("ts"), "day": F.to_date("ts")})
    return rounded(gat.generalization(e, ["symbol", "hour", "day"], "fwd_ret_5"), 6)


@query(
    "SELECT CAST(w AS INT) AS \"window\", CAST(a AS BIGINT) AS from_minute, CAST(b AS BIGINT) AS to_minute, count(y) AS n, round(avg(y), 4) AS mean, count(y) >= 5 AND avg(y) > 0 AS positive FROM ev, (SELECT w, floor(q[w]) AS a, floor(q[w + 1]) AS b FROM (SELECT quantile_cont(mi, [0.0, 0.25, 0.5, 0.75, 1.0]) AS q FROM ev), (SELECT unnest([1, 2, 3, 4]) AS w)) WHERE floor(mi) BETWEEN a AND b GROUP BY ALL",
    _MINUTES_SQL,
    RETURNS_SQL,
    LABELS_SQL,
    "ev AS (SELECT ts, fwd_ret_5 AS y, hour(ts) * 60 + minute(ts) + second(ts) / CAST(60 AS DOUBLE) AS mi FROM lab WHERE return_1 > 0)",
)
def session_windows(spark, sf_dir):
    e = ser.labels(ser.returns(bars(spark, sf_dir, "minute")), (5,)).where("return_1 > 0")
    return rounded(gat.session_windows(e, "fwd_ret_5"), 4)


@query(
    "SELECT round(avg(y), 4) AS base, round(avg(b), 4) AS shifted FROM (SELECT return_1, fwd_ret_5 AS y, lag(fwd_ret_5) OVER (PARTITION BY symbol ORDER BY ts) AS b FROM lab) WHERE return_1 > 0",
    BARS_SQL,
    RETURNS_SQL,
    LABELS_SQL,
)
def entry_perturbation(spark, sf_dir):
    return rounded(gat.entry_perturbation(ser.labels(ser.returns(bars(spark, sf_dir)), (5,)), F.col("return_1") > 0, "fwd_ret_5"), 4)


_BAR_DAYS_SQL = "bd AS (SELECT day, CASE WHEN pos < floor(n * CAST(0.5 AS DOUBLE)) THEN 'train' WHEN pos < floor(n * CAST(0.7 AS DOUBLE)) THEN 'validation' ELSE 'test' END AS part FROM (SELECT day, row_number() OVER (ORDER BY day) - 1 AS pos, count(*) OVER () AS n FROM (SELECT DISTINCT CAST(ts AS DATE) AS day FROM bars)))"


@query(
    "SELECT CASE WHEN v = 0 THEN 'PASS' ELSE 'FAIL' END AS status, CAST(v AS BIGINT) AS violations, c AS checked FROM (SELECT count(*) FILTER (o.part = 'train' AND l.part IN ('validation', 'test')) AS v, count(*) AS c FROM bars LEFT JOIN bd o ON o.day = CAST(ts AS DATE) LEFT JOIN bd l ON l.day = CAST(ts + INTERVAL 5 HOUR AS DATE))",
    BARS_SQL,
    _BAR_DAYS_SQL,
)
def split_integrity(spark, sf_dir):
    b = bars(spark, sf_dir)
    return gat.split_integrity(b, inf.splits(b.select(F.to_date("ts").alias("day")).distinct(), embargo=0), "5 hours")


# --- paths of trades -------------------------------------------------------------------------------------------------

_WALKED = "max(top - e) AS dd, max(CASE WHEN ret < 0 THEN k - stop END) AS streak"
_MONTE_SQL = (
    TRADES_SQL,
    "mixed AS (SELECT cfg, rep, ret, md5('42:' || rep || ':' || seq) AS m FROM trades, (SELECT unnest(range(1, 51)) AS rep))",
    "walk1 AS (SELECT cfg, rep, ret, m, sum(ret) OVER w AS e, row_number() OVER w AS k, CASE WHEN ret >= 0 THEN row_number() OVER w END AS own FROM mixed WINDOW w AS (PARTITION BY cfg, rep ORDER BY m ROWS UNBOUNDED PRECEDING))",
    "walk2 AS (SELECT *, greatest(max(e) OVER w, 0) AS top, coalesce(max(own) OVER w, 0) AS stop FROM walk1 WINDOW w AS (PARTITION BY cfg, rep ORDER BY m ROWS UNBOUNDED PRECEDING))",
    f"each AS (SELECT cfg, rep, count(*) AS n, {_WALKED} FROM walk2 GROUP BY cfg, rep)",
    "sorted AS (SELECT cfg, count(*) AS reps, any_value(n) AS n, avg(dd) AS mean, list_sort(list(dd)) AS d, list_sort(list(coalesce(streak, 0))) AS s FROM each GROUP BY cfg)",
)


@query(
    "SELECT cfg, reps, n, round(mean, 5) AS mean, round(d[3], 4) AS p5, round(d[26], 4) AS p50, round(d[48], 4) AS p95, round(d[50], 4) AS worst, CAST(s[26] AS INT) AS streak_p50, CAST(s[48] AS INT) AS streak_p95 FROM sorted",
    *_MONTE_SQL,
)
def monte_carlo_drawdown(spark, sf_dir):
    """Drawdowns and losing streaks of 50 random orders of each ledger."""
    m = pth.monte_carlo(trades(spark, sf_dir), "cfg", "ret", "seq", reps=50)
    four = {c: F.round(c, 4) for c in ("p5", "p50", "p95", "worst")}
    return m.withColumns({**four, "mean": F.round("mean", 5), **{c: F.col(c).cast("int") for c in ("streak_p50", "streak_p95")}})


@query(
    "SELECT cfg, round(sum(ret), 4) AS total, round(min((e - top) / top) * 100, 4) AS max_drawdown_pct, count(*) FILTER (e < top) AS trades_under FROM (SELECT *, greatest(max(e) OVER w, 1000) AS top FROM (SELECT cfg, seq, ret, 1000 + sum(ret) OVER w AS e FROM trades WINDOW w AS (PARTITION BY cfg ORDER BY seq ROWS UNBOUNDED PRECEDING)) WINDOW w AS (PARTITION BY cfg ORDER BY seq ROWS UNBOUNDED PRECEDING)) GROUP BY cfg",
    TRADES_SQL.replace("round((o_totalprice", "floor((o_totalprice").replace("CAST(4.9 AS DOUBLE), 4)", "CAST(4.9 AS DOUBLE))"),
)
def capital_drawdown(spark, sf_dir):
    """Deepest fall in percent of the peak, of whole-number returns on a capital of 1000."""
    return rounded(pth.capital_drawdown(_whole_returns(spark, sf_dir), "cfg", "ret", "seq", 1000.0), 4)


def _whole_returns(spark, sf_dir):
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    day = F.to_date("o_orderdate").alias("day")
    return o.select(F.col("o_orderpriority").alias("cfg"), F.col("o_orderkey").alias("seq"), day, F.floor((F.col("o_totalprice") % 1000.0) / 100.0 - 4.9).cast("double").alias("ret"))


# --- combinations of predicates --------------------------------------------------------------------------------------

#: predicates over bars with returns, momentum and candles; the numbers are the rounds' fixed thresholds
PREDICATES = {
    "mom5_up": "momentum_5 > 1", "mom5_dn": "momentum_5 < -1", "gap_up": "gap > 0.5", "gap_dn": "gap < -0.5", "pullback": "pullback > 2",
    "pos_high": "close_location > 0.8", "pos_low": "close_location < 0.2", "ret_up": "return_1 > 0", "ret_dn": "return_1 < 0", "five_dn": "return_5 < 0",
}
_PART_SQL = "CASE WHEN day(ts) <= 15 THEN 'train' WHEN day(ts) <= 22 THEN 'check' ELSE 'test' END"
_COMBO_SQL = (
    BARS_SQL,
    RETURNS_SQL,
    f"wide AS (SELECT symbol, ts, return_1, return_5, CASE WHEN count(return_1) {_prior(5)} >= 5 THEN avg(return_1) {_prior(5)} END AS momentum_5, (open / nullif(lag(close) {_W}), 0) - 1) * 100 AS gap, (max(high) {_W} ROWS 5 PRECEDING) - close) / nullif(max(high) {_W} ROWS 5 PRECEDING), 0) * 100 AS pullback, (close - low) / nullif(high - low, 0) AS close_location, (lead(close, 1) {_W}) / nullif(close, 0) - 1) * 100 AS y FROM ret)",
    f"flagged AS (SELECT symbol, ts, {_PART_SQL} AS part, CAST(floor(y * 1000000 + CAST(0.5 AS DOUBLE)) AS BIGINT) AS y, list_filter([" + ", ".join(f"CASE WHEN {test} THEN {k} END" for k, test in enumerate(PREDICATES.values())) + "], lambda x: x IS NOT NULL) AS held FROM wide WHERE y IS NOT NULL)",
    "one AS (SELECT *, unnest(held) AS a FROM flagged)",
    "one_lag AS (SELECT *, lag(ts) OVER (PARTITION BY a, part, symbol ORDER BY ts) AS before FROM one)",
    "one_sum AS (SELECT a, part, count(*) AS n, sum(y) AS total, count(*) FILTER (before IS NULL OR ts - before > INTERVAL 3 HOURS) AS clusters FROM one_lag GROUP BY a, part)",
    "pool AS (SELECT a FROM one_sum WHERE part = 'train' AND n >= 50 AND total > 0 AND clusters >= 10)",
    "two AS (SELECT x.symbol, x.ts, x.part, x.y, x.a, z.a AS b, x.held FROM one x JOIN one z ON x.symbol = z.symbol AND x.ts = z.ts AND x.a < z.a WHERE x.a IN (FROM pool) AND z.a IN (FROM pool))",
    "two_lag AS (SELECT *, lag(ts) OVER (PARTITION BY a, b, part, symbol ORDER BY ts) AS before FROM two)",
    "two_sum AS (SELECT a, b, part, count(*) AS n, sum(y) AS total, count(*) FILTER (before IS NULL OR ts - before > INTERVAL 3 HOURS) AS clusters FROM two_lag GROUP BY a, b, part)",
    "held_pairs AS (SELECT a, b FROM two_sum WHERE part = 'train' AND n >= 50)",
    "good_pairs AS (SELECT a, b FROM two_sum JOIN held_pairs USING (a, b) GROUP BY a, b HAVING count(*) FILTER (part = 'train' AND total > 0) > 0 AND count(*) FILTER (part = 'check' AND total > 0) > 0)",
    "tried AS (SELECT DISTINCT list_sort([g.a, g.b, p.a]) AS t FROM good_pairs g JOIN pool p ON p.a NOT IN (g.a, g.b))",
    "able AS (SELECT t FROM tried WHERE (t[1], t[2]) IN (SELECT (a, b) FROM held_pairs) AND (t[1], t[3]) IN (SELECT (a, b) FROM held_pairs) AND (t[2], t[3]) IN (SELECT (a, b) FROM held_pairs))",
    "three AS (SELECT w.*, t, lag(ts) OVER (PARTITION BY t, part, symbol ORDER BY ts) AS before FROM flagged w JOIN able ON list_has_all(w.held, t))",
    "three_sum AS (SELECT t, part, count(*) AS n, sum(y) AS total, count(*) FILTER (before IS NULL OR ts - before > INTERVAL 3 HOURS) AS clusters FROM three GROUP BY t, part)",
    f"names AS (SELECT {list(PREDICATES)} AS l)",
)


def _combinations(spark, sf_dir, depth):
    frame = ser.labels(ser.candles(ser.momentum(ser.returns(bars(spark, sf_dir)))), (1,))
    part = F.expr(_PART_SQL)
    return prd.search(frame, {n: F.expr(t) for n, t in PREDICATES.items()}, "fwd_ret_1", part, depth=depth).where(F.col("depth") == depth)


@query("SELECT l[a + 1] AS first, l[b + 1] AS second, part, n, total / n / 1000000 AS mean, clusters FROM two_sum JOIN held_pairs USING (a, b), names", *_COMBO_SQL)
def predicate_pairs(spark, sf_dir):
    """ANDs of two predicates with support in train: events, mean label and clusters per part."""
    return _combinations(spark, sf_dir, 2).select(F.col("names")[0].alias("first"), F.col("names")[1].alias("second"), "part", "n", "mean", "clusters")


@query(
    "SELECT l[t[1] + 1] AS first, l[t[2] + 1] AS second, l[t[3] + 1] AS third, part, n, total / n / 1000000 AS mean, clusters FROM three_sum JOIN (SELECT t FROM three_sum WHERE part = 'train' AND n >= 50) USING (t), names",
    *_COMBO_SQL,
)
def predicate_triples(spark, sf_dir):
    """ANDs of three under the pairs that gain in train and check."""
    return _combinations(spark, sf_dir, 3).select(*[F.col("names")[k].alias(c) for k, c in enumerate(("first", "second", "third"))], "part", "n", "mean", "clusters")


# --- recurrences by composition --------------------------------------------------------------------------------------


def _seeded_sql(value: str, p: int, weight: str) -> tuple[str, ...]:
    """Bars numbered per symbol, and the exponential mean of ``value`` walked by a recursive query."""
    return (
        "RECURSIVE dummy AS (SELECT 1)",
        BARS_SQL,
        f"valued AS (SELECT symbol, ts, {value} AS x FROM bars)",
        f"numbered AS (SELECT symbol, ts, x, row_number() {_W}) AS k, avg(x) {_W} ROWS {p - 1} PRECEDING) AS m FROM valued)",
        f"seeded AS (SELECT symbol, ts, k, CASE WHEN k = {p} THEN m END AS e FROM numbered WHERE k <= {p} UNION ALL SELECT n.symbol, n.ts, n.k, s.e + {weight} * (n.x - s.e) FROM seeded s JOIN numbered n ON n.symbol = s.symbol AND n.k = s.k + 1 WHERE s.k >= {p})",
    )


@query("SELECT symbol, ts, round(e, 5) AS ema_50 FROM seeded", *_seeded_sql("close", 50, "CAST(2 AS DOUBLE) / 51"))
def ema_scan(spark, sf_dir):
    """The 50-bar exponential mean, composed over weeks."""
    return rounded(scn.ema(bars(spark, sf_dir), 50, "ema_50", span="week"))


@query("SELECT symbol, ts, round(e, 5) AS atr_14 FROM seeded", *_seeded_sql(f"greatest(high - low, abs(high - lag(close) {_W})), abs(low - lag(close) {_W})))", 14, "CAST(1 AS DOUBLE) / 14"))
def wilder_scan(spark, sf_dir):
    """Average true range by Wilder's mean, composed over weeks."""
    return rounded(scn.wilder(bars(spark, sf_dir), 14, "atr_14", scn.true_range(), span="week"))


@query(
    "SELECT symbol, ts, label, now AS smoothed FROM walked",
    "RECURSIVE dummy AS (SELECT 1)",
    BARS_SQL,
    RETURNS_SQL,
    f"labelled AS (SELECT symbol, ts, CAST(CASE WHEN return_1 > 0 THEN 0 WHEN return_1 < 0 THEN 1 ELSE 2 END AS INT) AS label, row_number() {_W}) AS k FROM ret)",
    "walked AS (SELECT symbol, ts, label, k, label AS now, 2 AS need, -1 AS contender, 0 AS run FROM labelled WHERE k = 1 UNION ALL SELECT symbol, ts, label, k, CASE WHEN hit THEN label ELSE now END, CASE WHEN hit THEN 3 ELSE need END, CASE WHEN hit OR label = now THEN -1 ELSE label END, CASE WHEN hit OR label = now THEN 0 ELSE lasted END FROM (SELECT *, label <> now AND lasted >= need AS hit FROM (SELECT n.symbol, n.ts, n.label, n.k, w.now, w.need, CASE WHEN n.label = w.contender THEN w.run + 1 ELSE 1 END AS lasted FROM walked w JOIN labelled n ON n.symbol = w.symbol AND n.k = w.k + 1)))",
)
def smoothed_states(spark, sf_dir):
    """Direction of each bar, smoothed by a machine of few states that is composed over weeks."""
    kind = F.when(F.col("return_1") > 0, 0).when(F.col("return_1") < 0, 1).otherwise(2)
    return scn.smoothed(ser.returns(bars(spark, sf_dir)).withColumn("label", kind), "label", "smoothed", 3, 2, 1, span="week")


# --- regime models ---------------------------------------------------------------------------------------------------

_WALKS = {"atr": ("tr0", 14, 14, "14"), "trs": ("tr", 15, 14, "14"), "pls": ("plus", 15, 14, "14"), "mis": ("minus", 15, 14, "14"), "e20": ("close", 20, 20, "10.5"), "e50": ("close", 50, 50, "25.5")}
_DX = "coalesce(CASE WHEN pls + mis > 0 AND trs > 0 THEN 100 * abs(pls - mis) / (pls + mis) END, 0)"
_REGIME_SQL = (
    "RECURSIVE dummy AS (SELECT 1)",
    BARS_SQL,
    f"lagged AS (SELECT *, row_number() {_W}) AS k, lag(high) {_W}) AS h1, lag(low) {_W}) AS l1, lag(close) {_W}) AS c1 FROM bars)",
    "moved AS (SELECT *, greatest(high - low, abs(high - c1), abs(low - c1)) AS tr0, CASE WHEN k > 1 THEN greatest(high - low, abs(high - c1), abs(low - c1)) END AS tr, CASE WHEN k > 1 THEN CASE WHEN high - h1 > l1 - low AND high - h1 > 0 THEN high - h1 ELSE 0 END END AS plus, CASE WHEN k > 1 THEN CASE WHEN l1 - low > high - h1 AND l1 - low > 0 THEN l1 - low ELSE 0 END END AS minus FROM lagged)",
    "means AS (SELECT *, " + ", ".join(f"avg({x}) {_W} ROWS {n - 1} PRECEDING) AS m_{name}" for name, (x, _, n, _) in _WALKS.items()) + f", CASE WHEN count(tr0) {_W} ROWS 13 PRECEDING) >= 14 THEN log10(nullif(avg(tr0) {_W} ROWS 13 PRECEDING) / nullif(max(high) {_W} ROWS 13 PRECEDING) - min(low) {_W} ROWS 13 PRECEDING), 0), 0)) / log10(14) * 100 END AS chop FROM moved)",
    "walked AS (SELECT symbol, k, " + ", ".join(f"CAST(NULL AS DOUBLE) AS {name}" for name in _WALKS) + ", CAST(0 AS DOUBLE) AS dxs, CAST(NULL AS DOUBLE) AS adx FROM means WHERE k = 1 UNION ALL SELECT symbol, k, " + ", ".join(_WALKS)
    + f", CASE WHEN k BETWEEN 15 AND 28 THEN dxs + {_DX} ELSE dxs END, CASE WHEN k = 28 THEN (dxs + {_DX}) / 14 WHEN k > 28 THEN adx + ({_DX} - adx) / 14 END FROM (SELECT n.symbol, n.k, w.dxs, w.adx, "
    + ", ".join(f"CASE WHEN n.k = {first} THEN n.m_{name} WHEN n.k > {first} THEN w.{name} + (n.{x} - w.{name}) / {by} END AS {name}" for name, (x, first, _, by) in _WALKS.items())
    + " FROM walked w JOIN means n ON n.symbol = w.symbol AND n.k = w.k + 1))",
    "valued AS (SELECT m.*, w.atr, w.adx, w.e20, w.e50, CASE WHEN close > 0 THEN w.atr / close END AS vol FROM means m JOIN walked w USING (symbol, k))",
    f"ranked AS (SELECT *, list(vol) {_W} ROWS BETWEEN 100 PRECEDING AND 1 PRECEDING) AS past FROM valued)",
    "ruled AS (SELECT symbol, ts, open, high, low, close, volume, chop, CAST(ts + INTERVAL 330 MINUTES AS DATE) AS day, CASE WHEN chop IS NULL OR adx IS NULL OR vol IS NULL THEN 3 WHEN adx >= 20 THEN CASE WHEN coalesce(e20 >= e50, false) THEN 0 ELSE 1 END WHEN coalesce(CAST(len(list_filter(past, lambda x: x < vol)) AS DOUBLE) / nullif(len(past), 0), CAST(0.5 AS DOUBLE)) >= CAST(0.6 AS DOUBLE) THEN 2 ELSE 3 END AS regime FROM ranked)",
    "counted AS (SELECT symbol, day, count(*) AS n, " + ", ".join(f"count(*) FILTER (regime = {c}) AS n{c}" for c in range(4)) + " FROM ruled GROUP BY symbol, day)",
    "day_labels AS (SELECT symbol, day, CAST(CASE WHEN n3 >= greatest(n0, n1, n2) THEN 3 WHEN n0 >= greatest(n1, n2) THEN 0 WHEN n1 >= n2 THEN 1 ELSE 2 END AS INT) AS label FROM counted)",
)


@query("SELECT symbol, day, label FROM day_labels", *_REGIME_SQL)
def day_rule_labels(spark, sf_dir):
    """The rule regime that most bars of each session have."""
    return reg.day_rule_labels(ind.regimes(bars(spark, sf_dir)))


@query(
    "SELECT symbol, day, round(d0, 5) AS d0, round(d3, 5) AS d3, round(coalesce((o - lag(c) OVER w) / nullif(lag(c) OVER w, 0), 0), 5) AS d4, round(d6, 5) AS d6, d7 FROM (SELECT symbol, day, coalesce(arg_max_null(chop, ts), 62) / 100 AS d0, (max(high) - min(low)) / arg_max(close, ts) AS d3, arg_min(open, ts) AS o, arg_max(close, ts) AS c, (arg_max(close, ts) - arg_min(open, ts)) / nullif(arg_min(open, ts), 0) AS d6, least(3, sum(volume) / (count(*) * 20000)) AS d7 FROM ruled GROUP BY symbol, day) WINDOW w AS (PARTITION BY symbol ORDER BY day)",
    *_REGIME_SQL,
)
def day_features(spark, sf_dir):
    """What a session tells the day model; the columns that SQL can say."""
    d = reg.day_features(bars(spark, sf_dir))
    # the volume's share is a short decimal, often half a fifth digit: it is held as it is
    return d.select("symbol", "day", *[(F.round(c, 5) + 0.0).alias(c) for c in ("d0", "d3", "d4", "d6")], "d7")


_ROUTED = {rule: reg.ROUTER[rule] for rule in ("EMA", "RSI", "Squeeze", "Chop")}


@query(
    "SELECT rule, symbol, count(*) FILTER (contains(allow, CAST(label AS VARCHAR))) AS trade, count(*) AS n FROM ruled JOIN day_labels USING (symbol, day), (VALUES " + ", ".join(f"('{rule}', '{''.join(map(str, of))}')" for rule, of in _ROUTED.items()) + ") AS t(rule, allow) GROUP BY rule, symbol",
    *_REGIME_SQL,
)
def day_routed_bars(spark, sf_dir):
    """Bars that each rule may trade when sessions are routed by their rule regime."""
    b = bars(spark, sf_dir)
    days = reg.day_routing(b).persist()
    out = None
    for rule in _ROUTED:
        one = reg.day_mask(b, days, rule).groupBy("symbol").agg(F.count_if("trade").alias("trade"), F.count(F.lit(1)).alias("n")).select(F.lit(rule).alias("rule"), "symbol", "trade", "n")
        out = one if out is None else out.unionByName(one)
    return out


@query()
def regime_model(spark, sf_dir):
    """The softmax model of the regime ahead: bars by target, prediction and part."""
    return reg.regime_model(bars(spark, sf_dir), iterations=60).groupBy("trained", "target", "predicted").agg(F.count(F.lit(1)).alias("n"))


@query()
def day_model(spark, sf_dir):
    """Sessions routed by the softmax day model."""
    return reg.day_routing(bars(spark, sf_dir), "ml", iterations=60)


# --- audits ----------------------------------------------------------------------------------------------------------

_CUT = "hour(ts) = 13 AND day(ts) % 4 = 1"
_AUDITED = ("return_1", "return_5", "momentum_5", "gap", "pullback", "close_location", "rolling_high", "volume_zscore")


def _audited(frame):
    return ser.trailing(ser.candles(ser.momentum(ser.returns(frame))))


@query(
    "SELECT f AS feature, count(v) AS checked, CAST(0 AS BIGINT) AS deviations FROM (" + " UNION ALL ".join(f"SELECT '{c}' AS f, {c} AS v FROM told WHERE {_CUT}" for c in _AUDITED) + ") GROUP BY f",
    BARS_SQL,
    RETURNS_SQL,
    f"told AS (SELECT *, CASE WHEN count(return_1) {_prior(5)} >= 5 THEN avg(return_1) {_prior(5)} END AS momentum_5, (open / nullif(lag(close) {_W}), 0) - 1) * 100 AS gap, (max(high) {_W} ROWS 5 PRECEDING) - close) / nullif(max(high) {_W} ROWS 5 PRECEDING), 0) * 100 AS pullback, (close - low) / nullif(high - low, 0) AS close_location, CASE WHEN count(*) {_F120} >= 20 THEN max(high) {_F120} END AS rolling_high, CASE WHEN count(*) {_F120} >= 20 THEN (volume - avg(volume) {_F120}) / nullif(stddev_samp(volume) {_F120}, 0) END AS volume_zscore FROM ret)",
)
def lookahead_audit(spark, sf_dir):
    """Features at sampled bars, computed again without the future: none may change."""
    return aud.lookahead(bars(spark, sf_dir), _audited, _AUDITED, F.expr(_CUT), tolerance=1e-7).select("feature", "checked", "deviations")


@query()
def lookahead_rules(spark, sf_dir):
    """Positions of rules with memory at sampled bars, computed again without the future."""
    rules = ("EMA", "RSI", "SuperTrend", "SqueezeBreak", "TrendFollow", "ORB")

    def positions(frame):
        told = ind.signals(frame, *rules)
        return told.groupBy("symbol", "ts").agg(*[F.max(F.when(F.col("rule") == r_, F.col("position"))).alias(r_) for r_ in rules])

    return aud.lookahead(bars(spark, sf_dir), positions, rules, F.expr("hour(ts) = 13 AND day(ts) % 7 = 1"))


@query("SELECT ts, count(*) AS contracts, CAST(0 AS BIGINT) AS volume_mismatches, CAST(0 AS BIGINT) AS momentum_mismatches FROM chain WHERE day(ts) = 17 AND month(ts) % 3 = 1 GROUP BY ts", CHAIN_SQL)
def selector_audit(spark, sf_dir):
    """Selector ranks at sampled times against ranks made another way."""
    c = chain(spark, sf_dir).drop("symbol").withColumn("symbol", F.concat_ws("/", F.col("strike").cast("int"), "option_type"))
    ranked = rel.momentum_rank(rel.volume_rank(c))
    return aud.selectors(c, ranked, F.expr("day(ts) = 17 AND month(ts) % 3 = 1"))


@query(
    "SELECT count(*) AS trades, CAST(0 AS BIGINT) AS no_identity, CAST(0 AS BIGINT) AS bad_time, CAST(0 AS BIGINT) AS outsiders, CAST(0 AS BIGINT) AS off_bar, 'PASS' AS status FROM (SELECT close, lead(ts) OVER (PARTITION BY symbol ORDER BY ts) AS later FROM bars) WHERE later IS NOT NULL AND close > 0",
    BARS_SQL,
)
def ledger_audit(spark, sf_dir):
    """The event backtest's ledger: identities, times and entry prices."""
    b = bars(spark, sf_dir)
    return aud.ledger(trd.event_trades(b, F.lit(True), 5, 50.0, 50.0), b)


# --- configurations on a lattice -------------------------------------------------------------------------------------

_GRID = ("number", "size", "month")
_GRID_SQL = (
    "res AS (SELECT l_linenumber AS number, CAST(floor(l_quantity / 10) AS INT) AS size, CAST(month(l_shipdate) AS INT) AS month, count(*) AS trades, CAST(sum(CAST(floor(l_extendedprice) AS BIGINT) % 2001 - 1000) AS DOUBLE) / count(*) / 100 AS score FROM lineitem GROUP BY ALL)",
    "placed AS (SELECT *, dense_rank() OVER (ORDER BY number) AS x, dense_rank() OVER (ORDER BY size) AS y, dense_rank() OVER (ORDER BY month) AS z FROM res)",
)


def _grid_results(spark, sf_dir):
    line = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_linenumber", "l_quantity", "l_shipdate", "l_extendedprice")
    whole = F.floor("l_extendedprice").cast("long") % 2001 - 1000
    keys = [F.col("l_linenumber").alias("number"), F.floor(F.col("l_quantity") / 10).cast("int").alias("size"), F.month("l_shipdate").alias("month")]
    return line.groupBy(*keys).agg(F.count(F.lit(1)).alias("trades"), (F.sum(whole).cast("double") / F.count(F.lit(1)) / 100).alias("score"))


@query(
    "SELECT a.number, a.size, a.month, round(any_value(a.score), 6) + 0.0 AS score, count(*) AS neighbours, round(avg(CAST(b.score > 0 AS DOUBLE)), 6) AS positive_density, round(median(b.score), 6) + 0.0 AS median, round(min(b.score), 6) + 0.0 AS worst, round(max(b.score), 6) + 0.0 AS best, round(stddev_samp(b.score), 6) AS deviation, avg(CAST(b.score > 0 AS DOUBLE)) < CAST(0.4 AS DOUBLE) AS knife_edge FROM placed a JOIN placed b ON b.x BETWEEN a.x - 1 AND a.x + 1 AND b.y BETWEEN a.y - 1 AND a.y + 1 AND b.z BETWEEN a.z - 1 AND a.z + 1 GROUP BY a.number, a.size, a.month",
    *_GRID_SQL,
)
def parameter_neighbourhoods(spark, sf_dir):
    """Each configuration among those one step away on every axis."""
    x = lat.neighbourhoods(_grid_results(spark, sf_dir), _GRID, "score")
    return rounded(x.select(*_GRID, "score", "neighbours", "positive_density", "median", "worst", "best", "deviation", "knife_edge"), 6)


_CURVES = ", ".join(f"CASE WHEN a.trades >= 30 THEN abs(u{c}.score + d{c}.score - 2 * a.score) END AS c{c}" for c in "xyz")
_CURVE_JOINS = " ".join(f"LEFT JOIN placed {way}{c} ON {way}{c}.trades >= 10 AND " + " AND ".join(f"{way}{c}.{o} = a.{o}" + (f" {sign} 1" if o == c else "") for o in "xyz") for c in "xyz" for way, sign in (("u", "+"), ("d", "-")))


@query(
    f"SELECT number, size, month, axes_counted, round(pss, 6) AS pss, coalesce(pss > 0.5, false) AS knife_edge FROM (SELECT number, size, month, CAST(len(l) AS BIGINT) AS axes_counted, list_avg(l) AS pss FROM (SELECT number, size, month, list_filter([cx, cy, cz], lambda v: v IS NOT NULL) AS l FROM (SELECT a.number, a.size, a.month, {_CURVES} FROM placed a {_CURVE_JOINS})))",
    *_GRID_SQL,
)
def parameter_sensitivity(spark, sf_dir):
    """Mean second difference of each configuration's score along the axes."""
    return rounded(lat.sensitivity(_grid_results(spark, sf_dir), _GRID, "score", "trades").drop("score"), 6)


_WHOLE_SQL = "whole AS (SELECT o_orderpriority AS cfg, o_orderkey AS seq, CAST(o_orderdate AS DATE) AS day, floor((o_totalprice % CAST(1000 AS DOUBLE)) / CAST(100 AS DOUBLE) - CAST(4.9 AS DOUBLE)) AS ret FROM orders)"


@query(
    "SELECT cfg, trades, net, round(wins / trades * 100, 5) AS win_rate, round(gain / loss, 5) AS profit_factor, round(fall, 4) AS max_drawdown_pct, days, round(trades / days, 5) AS trades_per_day, round(mean / sd * sqrt(252), 4) AS sharpe, round(mean / down * sqrt(252), 4) AS sortino, round(net / trades, 5) AS expectancy, net + 1000 AS final_capital FROM (SELECT cfg, count(*) AS trades, sum(ret) AS net, count(*) FILTER (ret > 0) AS wins, sum(ret) FILTER (ret > 0) AS gain, -sum(ret) FILTER (ret <= 0) AS loss FROM whole GROUP BY cfg) JOIN (SELECT cfg, count(*) AS days, avg(d) AS mean, stddev_samp(d) AS sd, stddev_samp(d) FILTER (d < 0) AS down FROM (SELECT c.cfg, a.day, coalesce(sum(w.ret), 0) / 1000 AS d FROM (SELECT DISTINCT day FROM whole) a CROSS JOIN (SELECT DISTINCT cfg FROM whole) c LEFT JOIN whole w ON w.day = a.day AND w.cfg = c.cfg GROUP BY ALL) GROUP BY cfg) USING (cfg) JOIN (SELECT cfg, min((e - top) / top) * 100 AS fall FROM (SELECT cfg, e, greatest(max(e) OVER w, 1000) AS top FROM (SELECT cfg, seq, 1000 + sum(ret) OVER w AS e FROM whole WINDOW w AS (PARTITION BY cfg ORDER BY seq ROWS UNBOUNDED PRECEDING)) WINDOW w AS (PARTITION BY cfg ORDER BY seq ROWS UNBOUNDED PRECEDING)) GROUP BY cfg) USING (cfg)",
    _WHOLE_SQL,
)
def capital_metrics(spark, sf_dir):
    """The metrics block of whole-number ledgers on a capital of 1000, days without a trade among them."""
    whole = _whole_returns(spark, sf_dir)
    m = pth.capital_metrics(whole, whole, "cfg", "ret", "seq", "day", 1000.0)
    return rounded(m.withColumns({c: F.round(c, 4) for c in ("max_drawdown_pct", "sharpe", "sortino")}))


@query(
    "SELECT state_id, count(*) AS n FROM (SELECT CASE WHEN rg <= q[1] THEN 'vlow' WHEN rg <= q[2] THEN 'low' WHEN rg <= q[3] THEN 'mid' WHEN rg <= q[4] THEN 'high' ELSE 'vhigh' END || '/single/' || CASE WHEN vp IS NULL THEN 'na' WHEN vp <= 25 THEN 'low_vol' WHEN vp <= 50 THEN 'midlow' WHEN vp <= 75 THEN 'midhigh' WHEN vp <= 95 THEN 'high_vol' ELSE 'shock' END AS state_id FROM vols JOIN edges USING (symbol)) GROUP BY state_id",
    BARS_SQL,
    f"vols AS (SELECT symbol, high - low AS rg, CASE WHEN count(*) {_W} ROWS 119 PRECEDING) >= 20 THEN len(list_filter(list(volume) {_W} ROWS 119 PRECEDING), lambda x: x <= volume)) * CAST(100 AS DOUBLE) / count(*) {_W} ROWS 119 PRECEDING) END AS vp FROM bars)",
    "edges AS (SELECT symbol, list_transform([1, 2, 3, 4], lambda k: l[least(len(l), (k * len(l)) // 5 + 1)]) AS q FROM (SELECT symbol, list_sort(list(rg)) AS l FROM vols GROUP BY symbol))",
)
def state_buckets(spark, sf_dir):
    """Bars by the state of their range and volume, edges from merged sketches."""
    b = bars(spark, sf_dir).withColumn("range", F.col("high") - F.col("low")).withColumn("volume_percentile", ser.percentile_of("volume"))
    return sta.states(b, "range").groupBy("state_id").agg(F.count(F.lit(1)).alias("n"))


# --- what the data can support ---------------------------------------------------------------------------------------

_FACTS_SQL = (
    "width AS (SELECT ts, count(DISTINCT symbol) AS w FROM chain GROUP BY ts)",
    "facts AS (SELECT count(DISTINCT symbol) AS n_contracts, count(DISTINCT expiry) AS n_expiries, count(DISTINCT strike) AS n_strikes, count(DISTINCT option_type) AS n_option_types, (SELECT count(*) FROM width) AS snapshots, (SELECT count(*) FROM width WHERE w = (SELECT count(DISTINCT symbol) FROM chain)) AS whole_snapshots, count(DISTINCT CAST(ts AS DATE)) AS n_days, count(*) - count(close) AS missing_closes, count(*) - count(DISTINCT (ts, symbol)) AS repeated_rows, CAST(min(ts) AS TIMESTAMP) AS first_ts, CAST(max(ts) AS TIMESTAMP) AS last_ts, false AS has_bidask, count(oi) > 0 AS has_oi FROM chain)",
)


@query("SELECT *, round(whole_snapshots / snapshots, 4) AS completeness FROM facts", CHAIN_SQL, *_FACTS_SQL)
def chain_facts(spark, sf_dir):
    """Snapshots, contracts and gaps of the chain."""
    return cap.chain_facts(chain(spark, sf_dir))


def _module_sql(name: str, ok: str, why: str) -> str:
    return f"SELECT '{name}' AS module, CASE WHEN {ok} THEN 'AVAILABLE' ELSE 'UNAVAILABLE' END AS status, CASE WHEN {ok} THEN '' ELSE {why} END AS reason FROM facts"


@query(
    " UNION ALL ".join(
        [_module_sql(n, "n_contracts >= 1 AND snapshots > 10", "'no identifiable contracts/timestamps/prices'") for n in ("OPTION_DATA", "CHAIN_STRUCTURE")]
        + [_module_sql(n, "snapshots >= 5000", "'only ' || snapshots || ' snapshots (< 5000)'") for n in ("RAW_PRICE", "VOLUME", "LEAD_LAG", "SEQUENCE", "CHAIN_STATE")]
        + [_module_sql(n, f"{c} >= 2", f"'only ' || {c} || ' {w}'") for n, c, w in (("OPTION_TYPE_RELATIONSHIP", "n_option_types", "option type(s)"), ("STRIKE_RELATIONSHIP", "n_strikes", "strike(s)"), ("EXPIRY_RELATIONSHIP", "n_expiries", "expir(ies)"))]
        + [_module_sql("EXECUTABLE_MODEL", "has_bidask", "'no bid/ask fields; RESEARCH_PRICE_MODEL only'"), _module_sql("OOS_VALIDATION", "n_days >= 6", "'only ' || n_days || ' day(s); VALIDATION_INSUFFICIENT_DATA'")]
    ),
    CHAIN_SQL,
    *_FACTS_SQL,
)
def module_availability(spark, sf_dir):
    """Which analyses the chain supports, and why not."""
    return cap.modules(cap.chain_facts(chain(spark, sf_dir)), least_snapshots=5000)


_UNIVERSE_SQL = "uni AS (SELECT symbol, expiry, strike, option_type, count(*) AS rows, count(close) AS closes, round(sum(volume), 2) AS volume, count(close) > 0 AS searchable FROM chain GROUP BY ALL)"


@query("SELECT * FROM uni", CHAIN_SQL, _UNIVERSE_SQL)
def research_universe(spark, sf_dir):
    """Every contract that can be searched."""
    return cap.universe(chain(spark, sf_dir)).withColumn("volume", F.round("volume", 2))


@query(
    "SELECT symbol, expiry, strike, option_type, rows, strike_rank, strike_rank <= 3 AS first FROM uni JOIN (SELECT strike, CAST(row_number() OVER (ORDER BY sum(volume) DESC, strike) AS INT) AS strike_rank FROM uni GROUP BY strike) USING (strike)",
    CHAIN_SQL,
    _UNIVERSE_SQL,
)
def compute_priority(spark, sf_dir):
    """Contracts in the order of their strikes' volume."""
    return cap.priority(chain(spark, sf_dir)).select("symbol", "expiry", "strike", "option_type", "rows", "strike_rank", "first")


_HALVES = "SELECT option_type AS side, {} AS capability, {} AS status FROM chain GROUP BY option_type"
_SHARED = "SELECT side, '{0}' AS capability, CASE WHEN n >= 50 THEN 'AVAILABLE' WHEN n > 0 THEN 'PARTIAL' ELSE 'UNAVAILABLE' END AS status FROM (SELECT side, count(*) FILTER (k >= 2) AS n FROM (SELECT option_type AS side, ts, count(DISTINCT {1}) AS k FROM chain GROUP BY ALL) GROUP BY side)"


@query(
    " UNION ALL ".join(
        [_HALVES.format(f"'identity:{c}'", f"CASE WHEN count(*) FILTER ({c} IS NULL) = 0 THEN 'AVAILABLE' ELSE 'PARTIAL' END") for c in cap.IDENTITY]
        + [_HALVES.format(f"'field:{c}'", f"CASE WHEN count({c}) >= 0.8 * count(*) THEN 'AVAILABLE' ELSE 'PARTIAL' END") for c in ("open", "high", "low", "close", "volume", "oi")]
        + [_HALVES.format(f"'field:{c}'", "'UNAVAILABLE'") for c in ("bid", "ask")]
        + [_SHARED.format(f"overlap:{n}", c) for n, c in (("cross_contract", "symbol"), ("cross_expiry", "expiry"), ("cepe", "option_type"))]
    ),
    CHAIN_SQL,
)
def capability_map(spark, sf_dir):
    """Identity, fields and overlaps of each side of the chain."""
    return cap.capability_map(chain(spark, sf_dir), "option_type").withColumnRenamed("option_type", "side")


@query(
    "SELECT expiry, sum(n) AS rows, count(*) AS contracts, round(avg(n), 1) AS rows_per_contract, median(n) AS median_rows, min(n) AS least_rows, max(n) AS most_rows, any_value(days) AS days, any_value(gaps) AS gaps FROM (SELECT expiry, symbol, count(*) AS n FROM chain GROUP BY ALL) JOIN (SELECT expiry, count(DISTINCT CAST(ts AS DATE)) AS days, count(*) FILTER (epoch(ts) - epoch(b) > 86400) AS gaps FROM (SELECT expiry, ts, lag(ts) OVER (PARTITION BY expiry ORDER BY ts) AS b FROM (SELECT DISTINCT expiry, ts FROM chain)) GROUP BY expiry) USING (expiry) GROUP BY expiry",
    CHAIN_SQL,
)
def temporal_coverage(spark, sf_dir):
    """Rows, contracts and gaps of each expiry."""
    return cap.temporal_coverage(chain(spark, sf_dir), "expiry", "1 day")


_MARKS = {"up": "return_1 > 50", "down": "return_1 < -50", "flat": "abs(return_1) < 1", "never": "return_1 > 1e12"}


@query(
    "SELECT name, CAST(span AS INT) AS span, CASE WHEN span = 15 THEN 'UNAVAILABLE' WHEN coalesce(events, 0) >= 50 THEN 'AVAILABLE' ELSE 'INSUFFICIENT' END AS status, coalesce(marked, 0) AS marked, coalesce(events, 0) AS events, round(coalesce(events / marked, 0), 5) AS coverage, round(positive_rate, 5) AS positive_rate, round(median, 5) + 0.0 AS median, round(mean, 4) + 0.0 AS mean FROM (SELECT unnest(['up', 'down', 'flat', 'never']) AS name) CROSS JOIN (SELECT unnest([1, 3, 5, 10, 15]) AS span) LEFT JOIN (SELECT name, span, count(*) AS marked, count(y) AS events, avg(CAST(y > 0 AS INT)) AS positive_rate, median(round(y, 4)) AS median, avg(y) AS mean FROM ("
    + " UNION ALL ".join(f"SELECT '{n}' AS name, {s} AS span, {'NULL' if s == 15 else f'fwd_ret_{s}'} AS y FROM lab WHERE {m}" for n, m in _MARKS.items() for s in (1, 3, 5, 10, 15))
    + ") GROUP BY ALL) USING (name, span)",
    BARS_SQL,
    RETURNS_SQL,
    LABELS_SQL,
)
def horizon_eligibility(spark, sf_dir):
    """Which horizons have enough observed labels for each hypothesis."""
    f = ser.labels(ser.returns(bars(spark, sf_dir)), (1, 3, 5, 10))
    h = cap.horizon_eligibility(f, {n: F.expr(m) for n, m in _MARKS.items()}, (1, 3, 5, 10, 15))
    # the mean of two labels of four digits has five at most, so no tie is rounded
    return rounded(h.withColumn("mean", F.round("mean", 4)))


# --- board scores ----------------------------------------------------------------------------------------------------

_LEDGERS_SQL = "led AS (SELECT o_orderpriority || '-' || CAST(year(o_orderdate) AS VARCHAR) AS cfg, CAST(floor(o_totalprice) AS BIGINT) % 21 - 9 AS ret FROM orders)"
_PARTS_SQL = "parts AS (SELECT cfg, n, CASE WHEN e > 0 AND n > wins AND loss > 0 THEN (e / (loss / (n - wins))) / (e / (loss / (n - wins)) + 1) ELSE 0 END AS ret, wins / n * 0.5 + CASE WHEN e > 0 THEN 0.5 ELSE 0 END AS win_exp, CASE WHEN pf > 0 THEN pf / (pf + 1) ELSE 0 END AS pf, n / (n + 30) AS sample, CAST(1 AS DOUBLE) / (1 + abs(worst) / CAST(10 AS DOUBLE)) AS risk, CASE WHEN sh > 0 THEN sh / (sh + 2) ELSE 0 END AS sharpe FROM (SELECT *, greatest(-20, least(20, e / sd * (n / (n + 30)))) AS sh FROM (SELECT cfg, CAST(count(*) AS DOUBLE) AS n, CAST(count(*) FILTER (ret > 0) AS DOUBLE) AS wins, CAST(sum(ret) AS DOUBLE) / count(*) AS e, CAST(-sum(ret) FILTER (ret < 0) AS DOUBLE) AS loss, CAST(sum(ret) FILTER (ret > 0) AS DOUBLE) / -sum(ret) FILTER (ret < 0) AS pf, CAST(min(ret) AS DOUBLE) AS worst, stddev_samp(ret) AS sd FROM led GROUP BY cfg)))"
_FOUR = {k: f"floor({k} * 10000 + 0.5) / CAST(10000 AS DOUBLE)" for k in sco.WEIGHTS}


@query(
    "SELECT cfg, CAST(n AS BIGINT) AS n, " + ", ".join(f"{x} AS {k}" for k, x in _FOUR.items()) + ", floor((" + " + ".join(f"floor({k} * 10000 + 0.5) * {w}" for k, w in sco.WEIGHTS.items()) + " + 50) / 100) / CAST(10000 AS DOUBLE) AS composite, CASE WHEN n >= 30 THEN 'HIGH' WHEN n >= 10 THEN 'MEDIUM' ELSE 'LOW' END AS reliability, CASE WHEN n < 30 THEN 'INSUFFICIENT' WHEN n < 100 THEN 'LOW_SAMPLE' WHEN n < 200 THEN 'MODERATE_SAMPLE' ELSE 'STRONG_SAMPLE' END AS tier, CAST(CASE WHEN n < 100 THEN 6 WHEN n < 200 THEN 8 ELSE 10 END AS INT) AS cap FROM parts",
    _LEDGERS_SQL,
    _PARTS_SQL,
)
def strategy_scores(spark, sf_dir):
    """Composite score of each ledger of whole-number results; its worst trade stands for the drawdown."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderpriority", "o_orderdate", "o_totalprice")
    ret = F.floor("o_totalprice").cast("long") % 21 - 9
    led = o.select(F.concat_ws("-", "o_orderpriority", F.year("o_orderdate").cast("string")).alias("cfg"), ret.alias("ret"))
    r_, n = F.col("ret"), F.count(F.lit(1))
    gain, loss = F.sum(F.when(r_ > 0, r_)), -F.sum(F.when(r_ < 0, r_))
    m = led.groupBy("cfg").agg(n.alias("n"), F.count_if(r_ > 0).alias("wins"), (F.sum(r_) / n).alias("e"), loss.alias("loss"), ser.ratio(gain, loss).alias("gain_loss"), F.min(r_).alias("worst"), F.stddev_samp(r_).alias("sd"))
    parts = sco.score_parts(*[F.col(c) for c in ("n", "wins", "e", "loss", "gain_loss", "worst")], ser.ratio(F.col("e"), F.col("sd")))
    tier, most = sco.sample_gate(F.col("n"))
    told = m.select("cfg", "n", *[x.alias(k) for k, x in parts.items()], tier.alias("tier"), most.alias("cap"), sco.reliability(F.col("n")).alias("reliability"))
    return told.withColumn("composite", sco.composite({k: F.col(k) for k in parts}))
