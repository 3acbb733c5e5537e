"""Reading bar and chain files: roles by alias, layout by columns, typed rows, contract tokens, registry.

Column work happens on names only; all values are Spark expressions.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Names that files use for a role.
ALIASES = {
    "timestamp": ["timestamp", "ts", "datetime", "date_time", "time", "date"],
    "symbol": ["symbol", "tradingsymbol", "trading_symbol", "ticker", "instrument", "contract"],
    "expiry": ["expiry", "expiry_date", "expiration", "exp"],
    "strike": ["strike", "strike_price", "strikeprice"],
    "option_type": ["option_type", "otype", "optiontype", "type", "right", "cp"],
    "open": ["open", "o"],
    "high": ["high", "h"],
    "low": ["low", "l"],
    "close": ["close", "c", "ltp", "last", "price"],
    "volume": ["volume", "vol", "v", "qty"],
    "oi": ["oi", "open_interest", "openinterest"],
    "bid": ["bid", "best_bid"],
    "ask": ["ask", "best_ask"],
}
PRICES = ("open", "high", "low", "close")
MONTHS = {m: f"{k:02d}" for k, m in enumerate("JAN FEB MAR APR MAY JUN JUL AUG SEP OCT NOV DEC".split(), 1)}


def resolve(columns: list[str], role: str, overrides: dict[str, list[str]] | None = None) -> str | None:
    """The column that plays a role: the first alias that is there, whatever its case."""
    there = {c.strip().lower(): c for c in columns}
    for name in (overrides or {}).get(role, []) + ALIASES[role]:
        if name.lower() in there:
            return there[name.lower()]
    return None


def detect_layout(columns: list[str]) -> str:
    """long if strike and close are there, bars if only prices are, wide if a time and ``<contract>_<field>`` are."""
    if resolve(columns, "close"):
        return "long" if resolve(columns, "strike") else "bars"
    fields = {a for role in (*PRICES, "volume", "oi") for a in ALIASES[role]}
    if resolve(columns, "timestamp") and any("_" in c and c.rpartition("_")[2].lower() in fields for c in columns):
        return "wide"
    raise ValueError(f"neither long nor wide: {columns}")


def option_type(value: Column) -> Column:
    v = F.upper(F.trim(value))
    return F.when(v.isin("C", "CE", "CALL"), "CE").when(v.isin("P", "PE", "PUT"), "PE").otherwise(v)


def to_timestamp(value: Column) -> Column:
    """Epoch seconds, milliseconds, nanoseconds (by magnitude), YYYYMMDD, or a written time; null if none fits."""
    text = F.trim(value.cast("string"))
    number = text.try_cast("double")
    epoch = F.when(F.abs(number) < 1e11, number).when(F.abs(number) < 1e14, number / 1e3).otherwise(number / 1e9)
    day = F.try_to_timestamp(text, F.lit("yyyyMMdd"))
    written = [F.try_to_timestamp(F.replace(text, F.lit("T"), F.lit(" ")), F.lit(p)) for p in ("yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd HH:mm", "yyyy-MM-dd", "dd-MM-yyyy HH:mm:ss", "dd-MM-yyyy")]
    return F.when(text.rlike(r"^\d{8}$"), day).when(number.isNotNull(), F.timestamp_micros((epoch * 1e6).cast("long"))).otherwise(F.coalesce(*written)).cast("timestamp_ntz")


def to_expiry(value: Column) -> Column:
    """29SEP2026, 29-Sep-26, ISO dates and epochs as a date; null if none fits."""
    text = F.upper(F.regexp_replace(F.trim(value.cast("string")), r"[\s/]", "-"))
    parts = [F.regexp_extract(text, r"^(\d{1,2})-?([A-Z]{3})-?(\d{2}|\d{4})$", k) for k in (1, 2, 3)]
    month = F.create_map(*[F.lit(x) for pair in MONTHS.items() for x in pair])[parts[1]]
    year = F.when(F.length(parts[2]) == 2, F.concat(F.lit("20"), parts[2])).otherwise(parts[2])
    named = F.concat_ws("-", year, month, F.lpad(parts[0], 2, "0")).try_cast("date")
    return F.when((parts[1] != "") & month.isNotNull(), named).otherwise(to_timestamp(value).cast("date"))


def symbol_label(symbol: Column) -> Column:
    return F.upper(F.substring(F.element_at(F.split(F.trim(symbol), r"[_.\-\s]+"), 1), 1, 20))


def parse_token(token: Column) -> Column:
    """struct(underlying, expiry, strike, option_type, method) of a contract token such as NIFTY29SEP202624000CE."""
    t = F.upper(F.trim(token))
    kind = F.regexp_extract(t, r"(CE|PE|CALL|PUT|C|P)$", 1)
    body = F.regexp_replace(t, r"[-_ ]?(CE|PE|CALL|PUT|C|P)$", "")
    dated = r"^([A-Z&]*?)[-_ ]?(\d{1,2}[A-Z]{3}(?:20\d{2}|\d{2}))[-_ ]?(\d+(?:\.\d+)?)$"
    plain = r"^([A-Z&]*?)[-_ ]?(\d+(?:\.\d+)?)$"
    has_date = body.rlike(dated)
    strike = F.when(has_date, F.regexp_extract(body, dated, 3)).otherwise(F.regexp_extract(body, plain, 2))
    return F.struct(
        F.nullif(F.when(has_date, F.regexp_extract(body, dated, 1)).otherwise(F.regexp_extract(body, plain, 1)), F.lit("")).alias("underlying"),
        F.when(has_date, F.regexp_extract(body, dated, 2)).alias("expiry"),
        strike.try_cast("double").alias("strike"),
        F.when(kind != "", option_type(kind)).alias("option_type"),
        F.when(has_date, "dated").when(body.rlike(plain), "plain").otherwise("none").alias("method"),
    )


def load_long(frame: DataFrame, overrides: dict[str, list[str]] | None = None) -> DataFrame:
    """A long chain file or bar file in canonical columns; rows without a time or a finite close go."""
    found = {role: resolve(frame.columns, role, overrides) for role in ALIASES}
    if not found["timestamp"] or not found["close"]:
        raise ValueError("a time and a close are needed")
    col = lambda role: F.col(f"`{found[role]}`") if found[role] else F.lit(None).cast("string")
    number = lambda role: F.nullif(col(role).cast("string").try_cast("double"), F.lit(float("nan")))
    out = frame.select(
        to_timestamp(col("timestamp")).alias("ts"),
        F.coalesce(col("symbol").cast("string"), F.lit("SERIES")).alias("symbol"),
        col("expiry").cast("string").alias("expiry"),
        number("strike").alias("strike"),
        option_type(col("option_type").cast("string")).alias("option_type"),
        *[number(x).alias(x) for x in PRICES],
        F.coalesce(number("volume"), F.lit(0.0)).alias("volume"),
        *[number(x).alias(x) for x in ("oi", "bid", "ask")],
    )
    return out.where("ts is not null and close is not null")


def load_wide(frame: DataFrame) -> DataFrame:
    """A wide file, one column per contract and field, in canonical columns: one unpivot and one grouping."""
    time = resolve(frame.columns, "timestamp")
    roles = {a: role for role in (*PRICES, "volume", "oi") for a in ALIASES[role]}
    cells = [(c, *re.match(r"(.+)_([^_]+)$", c).groups()) for c in frame.columns if c != time and re.match(r".+_[^_]+$", c)]
    cells = [(c, token, roles[field.lower()]) for c, token, field in cells if field.lower() in roles]
    each = F.explode(F.array(*[F.struct(F.lit(t).alias("symbol"), F.lit(f).alias("field"), F.col(f"`{c}`").cast("string").try_cast("double").alias("v")) for c, t, f in cells]))
    long = frame.select(to_timestamp(F.col(f"`{time}`")).alias("ts"), each.alias("x")).select("ts", "x.*").where("ts is not null")
    wide = long.groupBy("ts", "symbol").agg(*[F.max(F.when(F.col("field") == f, F.col("v"))).alias(f) for f in (*PRICES, "volume", "oi")])
    token = parse_token(F.col("symbol"))
    return wide.where("close is not null").select("ts", "symbol", token["expiry"].alias("expiry"), token["strike"].alias("strike"), token["option_type"].alias("option_type"), *PRICES, F.coalesce("volume", F.lit(0.0)).alias("volume"), "oi")


def load(spark: SparkSession, path: str, overrides: dict[str, list[str]] | None = None) -> DataFrame:
    """A CSV or Parquet file of any layout in canonical columns."""
    raw = spark.read.parquet(path) if path.rstrip("/").endswith(".parquet") else spark.read.option("header", True).option("quote", '"').csv(path)
    return load_wide(raw) if detect_layout(raw.columns) == "wide" else load_long(raw, overrides)


def registry(chain: DataFrame) -> DataFrame:
    """One row per contract: identity (from columns, else from the token), bars, volume."""
    out = chain.groupBy("symbol").agg(
        F.first("expiry", ignorenulls=True).alias("expiry"), F.first("strike", ignorenulls=True).alias("strike"), F.first("option_type", ignorenulls=True).alias("option_type"), F.count(F.lit(1)).alias("bars"), F.sum("volume").alias("volume")
    )
    t = parse_token(F.col("symbol"))
    return out.select(
        "symbol",
        F.coalesce("expiry", t["expiry"]).alias("expiry"),
        F.coalesce("strike", t["strike"]).alias("strike"),
        F.coalesce("option_type", t["option_type"]).alias("option_type"),
        F.when(F.col("strike").isNotNull(), "columns").otherwise(t["method"]).alias("method"),
        "bars",
        "volume",
    )


def focus(chain: DataFrame, n_strikes: int) -> DataFrame:
    """Rows of the ``n_strikes`` strikes with the most volume (ties: lower strike)."""
    top = chain.groupBy("strike").agg(F.sum("volume").alias("_v")).orderBy(F.desc("_v"), "strike").limit(n_strikes)
    return chain.join(F.broadcast(top.select("strike")), "strike", "left_semi")


def largest_contract(chain: DataFrame) -> DataFrame:
    """Rows of the contract with the most rows (ties: smaller symbol)."""
    top = chain.groupBy("symbol").count().orderBy(F.desc("count"), "symbol").limit(1)
    return chain.join(F.broadcast(top.select("symbol")), "symbol", "left_semi")
