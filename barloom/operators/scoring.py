"""Board scores from many metrics, and what a profile's cells allow: columns over one row per configuration or cell.

Every part of a score lies between 0 and 1 and has four digits; the composite is added in whole hundredths of these, so it
does not hang on the order of sums.  Nulls count as 0.
"""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Weights in hundredths, and the constants of the parts.
WEIGHTS = {"ret": 25, "win_exp": 20, "pf": 15, "sample": 15, "risk": 15, "sharpe": 10}
SAMPLE_K, DRAWDOWN_SCALE, SHARPE_CAP, SHRINK_K = 30, 10.0, 20.0, 30
LEAST_RANKED = 30


def _number(x: Column) -> Column:
    return F.coalesce(x.cast("double"), F.lit(0.0))


def score_parts(n: Column, wins: Column, expectancy: Column, gross_loss: Column, profit_factor: Column, drawdown_pct: Column, sharpe: Column) -> dict[str, Column]:
    """Return per average loss, win rate with the sign of the expectancy, profit factor, sample, drawdown, shrunk and cut Sharpe."""
    n, wins, e, loss, pf, fall, sharpe = (_number(x) for x in (n, wins, expectancy, gross_loss, profit_factor, drawdown_pct, sharpe))
    zero = F.lit(0.0)
    losers = n - wins
    multiple = F.when((e > 0) & (losers > 0) & (loss > 0), e / (loss / F.nullif(losers, zero))).otherwise(zero)
    bent = lambda x, k=1.0: F.when(x > 0, x / (x + k)).otherwise(zero)
    shrunk = sharpe * (n / (n + SHRINK_K))
    parts = {
        "ret": bent(multiple),
        "win_exp": F.when(n > 0, wins / F.nullif(n, zero) * 0.5).otherwise(zero) + F.when(e > 0, 0.5).otherwise(zero),
        "pf": bent(pf),
        "sample": bent(n, SAMPLE_K),
        "risk": 1 / (1 + F.abs(fall) / DRAWDOWN_SCALE),
        "sharpe": bent(F.greatest(F.lit(-SHARPE_CAP), F.least(F.lit(SHARPE_CAP), shrunk)), 2.0),
    }
    return {k: F.floor(x * 10000 + 0.5) / 10000.0 for k, x in parts.items()}


def composite(parts: Mapping[str, Column]) -> Column:
    """Weighted sum of ``score_parts`` with four digits."""
    whole = reduce(lambda a, b: a + b, [F.round(parts[k] * 10000).cast("long") * w for k, w in WEIGHTS.items()])
    return F.floor((whole + 50) / 100) / 10000.0


def ranked_only(score: Column, n: Column, least: int = LEAST_RANKED) -> Column:
    """The score of configurations with enough trades; null says that a row is shown but not ranked."""
    return F.when(n >= least, score)


def reliability(n: Column) -> Column:
    return F.when(n >= 30, "HIGH").when(n >= 10, "MEDIUM").otherwise("LOW")


def sample_gate(n: Column) -> tuple[Column, Column]:
    """(tier, highest final score that a sample of this size may have)."""
    thin, low, some = n < 30, n < 100, n < 200
    tier = F.when(thin, "INSUFFICIENT").when(low, "LOW_SAMPLE").when(some, "MODERATE_SAMPLE").otherwise("STRONG_SAMPLE")
    return tier, F.when(low, 6).when(some, 8).otherwise(10)


def transfer(future: Column, option: Column, future_mean: Column, option_mean: Column) -> Column:
    """What became of a cell of the futures' profile in the options': by both classes and the signs of their means.

    A missing cell (null class) is insufficient data.
    """
    a, b = future == "RANKABLE", option == "RANKABLE"
    same = F.signum(_number(future_mean)) == F.signum(_number(option_mean))
    nothing = (future == "INSUFFICIENT") & (option == "INSUFFICIENT")
    out = F.when(future.isNull() | option.isNull() | nothing, "INSUFFICIENT_DATA").when(a & b & same, "TRANSFERRED")
    return out.when(a & ~b, "PARTIALLY_TRANSFERRED").when(~a & b, "OPTIONS_ONLY").otherwise("FAILED_TRANSFER")
