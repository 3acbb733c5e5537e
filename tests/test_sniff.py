"""Sniffed tables: shuffled columns, every separator, with and without a header."""

from __future__ import annotations

import random
from datetime import datetime, timedelta

import pytest

from barloom.sources import sniff


def table(draw, n=80, stamp="%Y-%m-%d %H:%M:%S"):
    rows, now = [], {"AAA": 100.0, "BBB": 250.0}
    for k in range(n):
        for symbol in now:
            o = now[symbol]
            c = round(o + draw.uniform(-2, 2), 2)
            t = datetime(2024, 1, 1, 9, 15) + timedelta(minutes=k)
            rows.append({"symbol": symbol, "timestamp": t.strftime(stamp), "open": o, "high": round(max(o, c) + draw.random(), 2), "low": round(min(o, c) - draw.random(), 2), "close": c, "volume": draw.randrange(1000, 90000)})
            now[symbol] = round(c + draw.uniform(-0.05, 0.05), 2)
    return rows


def lines_of(spark, rows, order, separator, header):
    text = [separator.join(f'"{r[c]}"' if c == "symbol" else str(r[c]) for c in order) for r in rows]
    if header:
        text = [separator.join(c.title() for c in order), *text, "", separator.join(order)]
    return spark.createDataFrame([(t,) for t in text], "value string").repartition(3)


@pytest.mark.parametrize("separator", sniff.SEPARATORS)
@pytest.mark.parametrize("header", [True, False])
def test_shuffled_columns(spark, separator, header):
    draw = random.Random(f"{separator}{header}")
    rows = table(draw)
    order = list(rows[0])
    draw.shuffle(order)
    lines = lines_of(spark, rows, order, separator, header)
    layout = sniff.sniff(lines)
    assert (layout.separator, layout.header) == (separator, header)
    assert layout.roles == {c: order.index(c) for c in order}
    got = sorted((r.symbol, r.ts, r.open, r.high, r.low, r.close, r.volume) for r in sniff.extract(lines, layout).collect())
    want = sorted((r["symbol"], datetime.strptime(r["timestamp"], "%Y-%m-%d %H:%M:%S"), r["open"], r["high"], r["low"], r["close"], float(r["volume"])) for r in rows)
    assert got == want
    assert sniff.extract(lines, layout, only="aaa").select("symbol").distinct().count() == 1


def test_days_clocks_and_epochs(spark):
    draw = random.Random(8)
    rows = [{**r, "timestamp": r["timestamp"][:8], "clock": r["timestamp"][8:]} for r in table(draw, stamp="%Y%m%d%H:%M")]
    lines = lines_of(spark, rows, ["timestamp", "clock", "symbol", "open", "high", "low", "close", "volume"], ",", False)
    out = sniff.extract(lines, sniff.sniff(lines))
    assert out.count() == len(rows) and str(out.agg({"ts": "max"}).first()[0]) == "2024-01-01 10:34:00"
    rows = [{**r, "timestamp": int(datetime.strptime(r["timestamp"], "%Y-%m-%d %H:%M:%S").timestamp())} for r in table(draw) if r["symbol"] == "AAA"]
    lines = lines_of(spark, rows, ["timestamp", "open", "high", "low", "close", "volume"], ";", False)
    out = sniff.extract(lines, sniff.sniff(lines))
    assert out.count() == len(rows) and out.select("symbol").distinct().first()[0] == "SERIES"


def test_files_and_what_is_no_table(spark, tmp_path):
    rows = table(random.Random(3), 30)
    (tmp_path / "a.txt").write_text("\n".join(f"{r['symbol']},{r['timestamp']},{r['open']},{r['high']},{r['low']},{r['close']},{r['volume']}" for r in rows) + "\nbroken,line\n,,,,,,\n")
    assert sniff.read_table(spark, f"{tmp_path}/a.txt", "BBB").count() == 30
    for bad in (["just words here", "and more"], ["a,b,c", "1,2,3"], []):
        with pytest.raises(ValueError):
            sniff.sniff(spark.createDataFrame([(x,) for x in bad], "value string"))
