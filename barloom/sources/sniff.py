"""Tables of prices whose separator, header and columns nobody has named.

The lines are profiled by aggregates over all of them: fields per separator, then what share of each column parses as a time,
a date, a number or a word, and for each two numeric columns how often one is at least the other and how far they are apart.
From these few figures the roles follow: the four numeric columns that lie closest together, of which one is never below and
one never above the others, are the prices; the open is the one that follows the close before it.  With a header the names
decide.  Blank lines and header lines, also repeated ones, are no data; quotes around fields go.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from itertools import combinations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .ingest import ALIASES, option_type, resolve, to_timestamp

SEPARATORS = (",", ";", "\t", "|")

# Words that make a line a header, two of them at least.
KNOWN = set(
    "symbol scrip instrument ticker date datetime timestamp time day expiry open high low close settle ltp volume vol qty quantity oi openinterest open_interest chginoi strike otype".split()
)
MORE = {"symbol": ["scrip"], "close": ["settle"], "volume": ["quantity", "traded"], "timestamp": ["day"], "option_type": ["callput"], "expiry": ["maturity"]}
KINDS = {"clock": r"^\d{1,2}:\d{2}(:\d{2})?$", "day8": r"^(19|20)\d{6}$", "stamp": r"^(?=.*\d)[0-9]{1,4}[-/][0-9A-Za-z]{1,3}[-/][0-9]{1,4}.*$"}


@dataclass
class Layout:
    """How a table is read: separator, whether it has a header, and the column of each role."""

    separator: str
    header: bool
    roles: dict[str, int]


def _fields(separator: str) -> Column:
    parts = F.split(F.trim("value"), re.escape(separator))
    return F.transform(parts, lambda x: F.regexp_replace(F.trim(x), "^[\"']|[\"']$", ""))


def _is_header(fields: Column) -> Column:
    known = F.size(F.filter(fields, lambda x: F.lower(x).isin(*sorted(KNOWN))))
    numbers = F.size(F.filter(fields, lambda x: x.try_cast("double").isNotNull()))
    return (known >= 2) & (numbers * 2 < F.size(fields))


def _separator(lines: DataFrame) -> str:
    """The separator that makes the most fields of the median line; of equal ones the first."""
    counts = lines.agg(*[F.percentile_approx(F.size(_fields(s)), 0.5) for s in SEPARATORS]).first()
    return max(zip(SEPARATORS, counts, strict=True), key=lambda x: x[1] or 0)[0]


def sniff(lines: DataFrame) -> Layout:
    """The layout of ``lines`` (value string); ValueError if there are no four price columns or no time."""
    lines = lines.where(F.trim("value") != "")
    separator = _separator(lines)
    rows = lines.select(_fields(separator).alias("f"))
    head = rows.where(_is_header(F.col("f"))).agg(F.min("f")).first()[0]
    if head is not None:
        names = [h.lower() for h in head]
        found = {role: resolve(names, role) or resolve(names, role, MORE) for role in ALIASES}
        roles = {role: names.index(name) for role, name in found.items() if name}
        if "date" in names and "time" in names:
            roles |= {"timestamp": names.index("date"), "clock": names.index("time")}
        layout = Layout(separator, True, roles)
    else:
        layout = Layout(separator, False, _roles(rows))
    if not {"timestamp", "open", "high", "low", "close"} <= set(layout.roles):
        raise ValueError(f"no time or no prices in {layout.roles}")
    return layout


def _roles(rows: DataFrame) -> dict[str, int]:
    width = rows.agg(F.percentile_approx(F.size("f"), 0.5)).first()[0] or 0
    if not width:
        return {}
    cells = [F.nullif(F.get("f", F.lit(k)), F.lit("")) for k in range(width)]
    number = [c.try_cast("double") for c in cells]
    asked = {f"n{k}": F.count(c) for k, c in enumerate(cells)}
    for name, pattern in KINDS.items():
        asked |= {f"{name}{k}": F.count_if(c.rlike(pattern)) for k, c in enumerate(cells)}
    asked |= {f"num{k}": F.count(x) for k, x in enumerate(number)} | {f"min{k}": F.min(x) for k, x in enumerate(number)}
    for a, b in combinations(range(width), 2):
        x, y = number[a], number[b]
        asked[f"ge{a}_{b}"], asked[f"ge{b}_{a}"] = F.count_if(x < y), F.count_if(y < x)  # how often not
        asked[f"far{a}_{b}"] = F.avg(F.when((x > 0) & (y > 0), F.abs(F.ln(F.nullif(x, F.lit(0.0)) / F.nullif(y, F.lit(0.0))))))
    told = rows.agg(*[c.alias(n) for n, c in asked.items()]).first().asDict()

    def kind(k: int) -> str:
        n = told[f"n{k}"]
        if not n:
            return "empty"
        for name in KINDS:
            if told[f"{name}{k}"] * 2 > n:
                return name
        return "number" if told[f"num{k}"] * 2 > n else "word"

    kinds = [kind(k) for k in range(width)]
    roles: dict[str, int] = {}
    first = lambda name: next((k for k, x in enumerate(kinds) if x == name), None)
    numbers = [k for k, x in enumerate(kinds) if x == "number"]
    time = next((k for k in (first("stamp"), first("day8")) if k is not None), None)
    if time is None:  # an epoch: a column of great numbers
        time = next((k for k in numbers if (told[f"min{k}"] or 0) >= 1e8), None)
        numbers = [k for k in numbers if k != time]
    if time is not None:
        roles["timestamp"] = time
        if kinds[time] in ("day8", "stamp") and first("clock") is not None:
            roles["clock"] = first("clock")
    if first("word") is not None:
        roles["symbol"] = first("word")
    far = lambda a, b: told[f"far{min(a, b)}_{max(a, b)}"]
    best = None
    for four in combinations(numbers, 4):
        tops = [a for a in four if all(told[f"ge{a}_{b}"] == 0 for b in four if b != a)]
        lows = [a for a in four if all(told[f"ge{b}_{a}"] == 0 for b in four if b != a)]
        spread = [far(a, b) for a, b in combinations(four, 2)]
        if tops and lows and None not in spread and (best is None or max(spread) < best[0]):
            low = next((a for a in lows if a != tops[0]), None)
            if low is not None:
                best = (max(spread), tops[0], low, [a for a in four if a not in (tops[0], low)])
    if best is None or time is None:
        return roles
    _, high, low, (a, b) = best
    roles |= {"high": high, "low": low} | _open_and_close(rows, roles, cells, number, a, b)
    rest = [k for k in numbers if k not in roles.values()]
    return roles | dict(zip(("volume", "oi"), rest, strict=False))


def _open_and_close(rows: DataFrame, roles: dict[str, int], cells: list[Column], number: list[Column], a: int, b: int) -> dict[str, int]:
    """Which of two price columns follows the other one's last value; without a difference the first is the open."""
    symbol = cells[roles["symbol"]] if "symbol" in roles else F.lit("")
    told = rows.select(symbol.alias("s"), _time(cells, roles).alias("t"), number[a].alias("a"), number[b].alias("b")).where("t is not null")
    before = Window.partitionBy("s").orderBy("t")
    gaps = told.select(F.abs(F.col("a") - F.lag("b").over(before)).alias("a_opens"), F.abs(F.col("b") - F.lag("a").over(before)).alias("b_opens")).agg(F.avg("a_opens"), F.avg("b_opens")).first()
    swapped = gaps[0] is not None and gaps[1] < gaps[0]
    return {"open": b, "close": a} if swapped else {"open": a, "close": b}


def _time(cells: list[Column], roles: dict[str, int]) -> Column:
    stamp = cells[roles["timestamp"]]
    if "clock" not in roles:
        return to_timestamp(stamp)
    day = F.date_format(to_timestamp(stamp), "yyyy-MM-dd")
    clock = cells[roles["clock"]]
    whole = F.when(clock.rlike(r"^\d{1,2}:\d{2}$"), F.concat(clock, F.lit(":00"))).otherwise(clock)
    return F.try_to_timestamp(F.concat_ws(" ", day, F.lpad(whole, 8, "0")), F.lit("yyyy-MM-dd HH:mm:ss")).cast("timestamp_ntz")


def extract(lines: DataFrame, layout: Layout, only: str | None = None) -> DataFrame:
    """``lines`` in canonical columns: ts, symbol, expiry, strike, option_type, open, high, low, close, volume, oi.

    Rows without a time or one of the prices go; symbols are in upper case, SERIES where there is none; ``only`` keeps one.
    """
    f = _fields(layout.separator)
    rows = lines.where(F.trim("value") != "").select(f.alias("f")).where(~_is_header(F.col("f")))
    width = max(layout.roles.values()) + 1
    cells = [F.nullif(F.get("f", F.lit(k)), F.lit("")) for k in range(width)]
    cell = lambda role: cells[layout.roles[role]] if role in layout.roles else F.lit(None).cast("string")
    number = lambda role: F.nullif(cell(role).try_cast("double"), F.lit(float("nan")))
    out = rows.select(
        _time(cells, layout.roles).alias("ts"), F.upper(F.coalesce(cell("symbol"), F.lit("SERIES"))).alias("symbol"), cell("expiry").alias("expiry"), number("strike").alias("strike"),
        option_type(cell("option_type")).alias("option_type"), *[number(x).alias(x) for x in ("open", "high", "low", "close")], F.coalesce(number("volume"), F.lit(0.0)).alias("volume"), number("oi").alias("oi"),
    )
    out = out.where("ts is not null and open is not null and high is not null and low is not null and close is not null")
    return out if only is None else out.where(F.col("symbol") == only.upper())


def read_table(spark: SparkSession, path: str, only: str | None = None) -> DataFrame:
    """A text table of any separator, with or without a header, in canonical columns."""
    lines = spark.read.text(path)
    return extract(lines, sniff(lines), only)
