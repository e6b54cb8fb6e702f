"""Golden rows, edge fixtures, and brute force over random trades."""

import math
import random
import shutil
from pathlib import Path

import pytest

from tapewise.operators import compute_features, drop_late, late_totals
from tapewise.plans import catalog
from tapewise.schemas import MINUTE, SECOND
from tapewise.sources import trades_from_rows

B = 1_700_000_000_000_000_000

#: Inputs (second, price, qty, side) and rows (vwap_1m, vwap_5m, rv_1m, rv_5m, ofi_1m, count).
GOLDEN = [
    ([(0, 30000, 1, "buy")], [(30000, 30000, 0, 0, 1, 1)]),
    ([(0, 30000, 1, "buy"), (10, 30000, 3, "sell")], [(30000, 30000, 0, 0, 1, 1), (30000, 30000, 0, 0, -2, 2)]),
    ([(0, 30000, 1, "buy"), (10, 30300, 2, "buy"), (20, 29900, 1.5, "sell")], [(30000, 30000, 0, 0, 1, 1), (30200, 30200, 9.900908408750885e-05, 9.900908408750885e-05, 3, 2), (30100, 30100, 0.00027561277439173845, 0.00027561277439173845, 1.5, 3)]),
    ([(0, 30000, 5, "buy"), (61, 31000, 2, "sell")], [(30000, 30000, 0, 0, 5, 1), (31000, 30285.714285714286, 0, 0.0010751724807631395, -2, 1)]),
    ([(0, 40000, 3, "buy"), (5, 40100, 5, "sell"), (10, 40050, 2, "buy"), (15, 40200, 1, "buy")], [(40000, 40000, 0, 0, 3, 1), (40062.5, 40062.5, 6.234410726096585e-06, 6.234410726096585e-06, -2, 2), (40060, 40060, 7.791068193349985e-06, 7.791068193349985e-06, 0, 3), (40072.72727272727, 40072.72727272727, 2.176612039600434e-05, 2.176612039600434e-05, 1, 4)]),
]


def trades(spark, rows, symbol="BTCUSDT"):
    return trades_from_rows(spark, [(B + int(t * SECOND), r[3] if len(r) > 3 else symbol, float(p), float(q), side) for t, p, q, side, *r in rows] if not (rows and len(rows[0]) == 5) else [(B + int(t * SECOND), s, float(p), float(q), side) for t, p, q, side, s in rows])


def got(spark, rows, mode):
    return sorted(compute_features(trades(spark, rows), mode).collect(), key=lambda r: (r["symbol"], r["ts"], r["trade_count_1m"]))


@pytest.mark.parametrize("mode", ["event_time", "arrival"])
@pytest.mark.parametrize("case", range(len(GOLDEN)))
def test_golden(spark, case, mode):
    rows, expected = GOLDEN[case]
    out = got(spark, rows, mode)
    assert len(out) == len(expected)
    for r, e in zip(out, expected):
        for name, value in zip(("vwap_1m", "vwap_5m", "rv_1m", "rv_5m", "ofi_1m"), e):
            assert abs(r[name] - value) <= 1e-9
        assert r["vwap_15m"] == pytest.approx(e[1], abs=1e-9)
        assert r["trade_count_1m"] == e[5] and r["microprice"] is None


@pytest.mark.parametrize("mode", ["event_time", "arrival"])
def test_edges(spark, mode):
    edge = got(spark, [(0, 100, 1, "buy"), (60, 100, 2, "buy")], mode)[-1]
    assert edge["trade_count_1m"] == 2 and edge["ofi_1m"] == 3  # the left edge is inside
    ties = got(spark, [(0, 100, 1, "buy"), (0, 110, 1, "buy")], mode)
    assert [r["trade_count_1m"] for r in ties] == [1, 2]
    assert ties[1]["vwap_1m"] == pytest.approx(105) and ties[1]["rv_1m"] == pytest.approx(math.log(1.1) ** 2)
    zero = got(spark, [(0, 100, 0, "buy")], mode)[0]
    assert zero["vwap_1m"] is None and zero["ofi_1m"] == 0 and zero["rv_1m"] == 0 and zero["trade_count_1m"] == 1
    assert all(r["rv_1m"] == 0 for r in got(spark, [(0, 100, 1, "buy"), (1, 0, 1, "buy"), (2, 100, 1, "buy")], mode))
    last = got(spark, [(0, 100, 1, "buy"), (61, 110, 1, "buy"), (62, 121, 1, "buy")], mode)[-1]
    assert last["rv_1m"] == pytest.approx(math.log(1.1) ** 2) and last["rv_5m"] == pytest.approx(2 * math.log(1.1) ** 2)
    two = got(spark, [(0, 1, 1, "buy", "A"), (0, 1, 1, "buy", "B"), (1, 1, 1, "buy", "A")], mode)
    assert [(r["symbol"], r["trade_count_1m"]) for r in two] == [("A", 1), ("A", 2), ("B", 1)]


LATE = [(0, 1, 1, "buy"), (10, 1, 1, "buy"), (9, 1, 1, "buy"), (7, 1, 1, "buy"), (8, 1, 1, "buy")]


def test_late(spark):
    rows = trades(spark, LATE)
    assert {(r["ts"] - B) // SECOND: r["trade_count_1m"] for r in compute_features(rows, "arrival").collect()} == {0: 1, 10: 2, 9: 3, 8: 4}
    # 9 is less than two seconds late as well: in event time it stands between 8 and 10
    assert {(r["ts"] - B) // SECOND: r["trade_count_1m"] for r in compute_features(rows, "event_time").collect()} == {0: 1, 8: 2, 9: 3, 10: 4}
    assert drop_late(rows).count() == 4
    assert {r["symbol"]: r["late_drop_total"] for r in late_totals(rows).collect()} == {"BTCUSDT": 1, None: 1}


def test_brute_force(spark):
    rng = random.Random(1)
    t, rows = 0, []
    for _ in range(1500):
        t += rng.choice([0, 0, 1, 3, 20, 100])
        rows.append((t, rng.uniform(90, 110), rng.choice([0, 0.5, 1, 2]), rng.choice(["buy", "sell"]), rng.choice("AB")))
    out = {r["seq"]: r for r in compute_features(trades(spark, rows), "event_time", stretch=1, keep=("seq",)).collect()}
    assert len(out) == len(rows)
    for i, (t, _, _, _, s) in enumerate(rows):
        seen = [r for r in rows[: i + 1] if r[4] == s]
        r = out[i]
        for name, span in (("1m", 60), ("5m", 300), ("15m", 900)):
            w = [x for x in seen if x[0] >= t - span]
            q = sum(x[2] for x in w)
            assert (r[f"vwap_{name}"] is None) == (q == 0)
            if q:
                assert r[f"vwap_{name}"] == pytest.approx(sum(x[1] * x[2] for x in w) / q, abs=1e-9)
            if span < 900:
                assert r[f"rv_{name}"] == pytest.approx(sum(math.log(b[1] / a[1]) ** 2 for a, b in zip(w, w[1:])), abs=1e-9)
        w = [x for x in seen if x[0] >= t - 60]
        assert r["trade_count_1m"] == len(w)
        assert r["ofi_1m"] == pytest.approx(sum(x[2] if x[3] == "buy" else -x[2] for x in w), abs=1e-9)


def test_same_instant_returns_can_be_off(spark):
    rows = trades(spark, [(0, 100, 1, "buy"), (0, 110, 1, "buy")])
    assert max(r["rv_1m"] for r in compute_features(rows, "event_time", same_ts_returns=False).collect()) == 0
    assert MINUTE == 60 * SECOND


def test_arrival_by_brute_force(spark):
    """Trades out of order by up to three seconds, over the edges of stretches."""
    rng = random.Random(7)
    t, rows = 3500.0, []
    for _ in range(900):
        t += rng.choice([0, 0.3, 0.9, 2, 15])
        rows.append((t - rng.choice([0, 0, 0.5, 1.9, 2.0, 3.1]), rng.choice([0.0, 90.0, 101.0, 99.5]), rng.choice([0, 0.5, 2]), rng.choice(["buy", "sell"]), rng.choice("AB")))
    out = {(r["symbol"], r["ts"], r["trade_count_1m"], round(r["ofi_1m"], 6)): r for r in compute_features(trades(spark, rows), "arrival", stretch=1).collect()}
    kept, marks, n = {"A": [], "B": []}, {"A": 0, "B": 0}, 0
    for t, p, q, side, s in rows:
        ts = B + int(t * SECOND)
        if ts < marks[s] - 2 * SECOND:
            continue
        marks[s] = max(marks[s], ts)
        kept[s].append((ts, float(p), float(q), q if side == "buy" else -q))
        w = {m: [x for x in kept[s] if x[0] >= ts - m * MINUTE] for m in (1, 5, 15)}
        r = out[s, ts, len(w[1]), round(sum(x[3] for x in w[1]), 6)]
        n += 1
        for m in (1, 5, 15):
            volume = sum(x[2] for x in w[m])
            assert (r[f"vwap_{m}m"] is None) == (volume == 0)
            if volume:
                assert r[f"vwap_{m}m"] == pytest.approx(sum(x[1] * x[2] for x in w[m]) / volume, abs=1e-9)
            if m < 15:
                assert r[f"rv_{m}m"] == pytest.approx(sum(math.log(b[1] / a[1]) ** 2 for a, b in zip(w[m], w[m][1:]) if a[1] > 0 and b[1] > 0), abs=1e-9)
    assert n == compute_features(trades(spark, rows), "arrival").count() < len(rows)


def _tied(spark, folder, copies=3, n=400):
    """Events of which every instant holds one trade of each copy, under other ids, prices and sides."""
    rng, t = random.Random(5), 1_704_067_200_000_000
    rows = []
    for i in range(n):
        t += rng.choice([1, 20, 100, 4000]) * 1_000_000 if i % 9 else 9 * 86_400_000_000 // 20
        kind = rng.choice(["click", "view"])
        rows += [(i + 1001 * c, t, kind, round(rng.uniform(1, 200), 2)) for c in range(copies)]
    events = spark.createDataFrame(rows, "event_id long, us long, event_type string, value double")
    events.selectExpr("event_id", "cast(timestamp_micros(us) as timestamp_ntz) AS ts", "event_type", "value", "'{}' AS props").coalesce(1).write.parquet(f"{folder}/events.parquet")
    return str(folder)


def _same_as_sql(spark, folder, name):
    """The registered query against its SQL; rv columns are left out: which trade of an
    instant their first_value takes is open in SQL."""
    duckdb = pytest.importorskip("duckdb")
    out = catalog.QUERIES[name](spark, folder)
    wanted = [c for c in out.columns if not c.startswith("rv_")]
    with duckdb.connect() as c:
        c.execute("SET TimeZone = 'UTC'")
        c.execute(f"CREATE VIEW events AS SELECT * FROM '{folder}/events.parquet/*.parquet'")
        expected = c.execute(f"SELECT {', '.join(wanted)} FROM ({catalog.ORACLES[name]})").fetchall()
    key = lambda r: [(x is None, x or 0) for x in r]
    got = sorted((tuple(r) for r in out.select(*wanted).collect()), key=key)
    assert len(got) == len(expected) > 0
    for a, b in zip(got, sorted(expected, key=key)):
        assert a == pytest.approx(b, abs=2e-6)


@pytest.fixture(scope="module")
def tied(spark, tmp_path_factory):
    return _tied(spark, tmp_path_factory.mktemp("tied"))


def test_one_instant_shares_its_windows(spark):
    rows = trades(spark, [(0, 100, 1, "buy"), (0, 110, 1, "sell"), (30, 120, 2, "buy"), (30, 120, 1, "buy")])
    out = sorted((r["ts"], r["trade_count_1m"], r["ofi_1m"], r["vwap_1m"]) for r in compute_features(rows, "event_time", peers=True).collect())
    assert [r[1:3] for r in out] == [(2, 0), (2, 0), (4, 3), (4, 3)]
    assert [r[3] for r in out] == pytest.approx([105, 105, 114, 114])


@pytest.mark.parametrize("name", ["feature_rows", "trade_count_rolling", "jsonl_features", "q2_top_symbols", "q5_ofi_momentum", "sql_q2_top_symbols", "storage_all_rows", "stored_sql_q2", "stored_sql_q5"])
def test_tied_events_as_in_sql(spark, tied, name):
    _same_as_sql(spark, tied, name)


@pytest.fixture(scope="module")
def copied(spark, tmp_path_factory):
    """Events 60 times over under shifted ids, as larger copies of the tables are made: prices of an instant are equal."""
    folder, rng, t, rows = tmp_path_factory.mktemp("copied"), random.Random(11), 1_704_900_000_000_000, []
    for i in range(120):
        t += rng.choice([1, 20, 50, 2000]) * 1_000_000 if i % 9 else 86_400_000_000
        kind, price = rng.choice(["click", "view"]), round(rng.uniform(1, 200), 2)
        rows += [(i + 120 * c, t, kind, price) for c in range(60)]
    events = spark.createDataFrame(rows, "event_id long, us long, event_type string, value double")
    events.selectExpr("event_id", "cast(timestamp_micros(us) as timestamp_ntz) AS ts", "event_type", "value", "'{}' AS props").coalesce(1).write.parquet(f"{folder}/events.parquet")
    return str(folder)


@pytest.mark.parametrize("name", ["jsonl_features", "storage_all_rows", "q2_top_symbols", "q5_ofi_momentum", "sql_q2_top_symbols", "stored_sql_q2", "stored_sql_q5", "trade_count_rolling"])
def test_sixty_copies_exactly_as_in_sql(spark, copied, name):
    """Whole rows, volatilities too: one thread of DuckDB keeps an instant's order of arrival, so that its first_value is settled."""
    duckdb = pytest.importorskip("duckdb")
    with duckdb.connect(config={"threads": 1}) as c:
        c.execute("SET TimeZone = 'UTC'")
        c.execute(f"CREATE VIEW events AS SELECT * FROM '{copied}/events.parquet/*.parquet'")
        expected = c.execute(catalog.ORACLES[name]).fetchall()
    key = lambda r: [(x is None, x or 0) for x in r]
    got = sorted((tuple(r) for r in catalog.QUERIES[name](spark, copied).collect()), key=key)
    assert len(expected) > 0 and got == sorted(expected, key=key)


@pytest.fixture(scope="module")
def calmed(spark, tmp_path_factory):
    """A day of wild prices, then of quiet ones, in which sums over the day must leave no trace of the wild."""
    folder, rng, t, rows = tmp_path_factory.mktemp("calmed"), random.Random(3), 1_704_931_200_000_000, []
    for i in range(3000):
        t += 3_000_000 + rng.randrange(1_000_000) if i != 2000 else 3_600_000_000
        price = round(rng.uniform(1, 200), 2) if i >= 2000 else [0.01, 1e6][i % 2] * rng.uniform(1, 2)
        rows.append((i, t, "click", price))
    events = spark.createDataFrame(rows, "event_id long, us long, event_type string, value double")
    events.selectExpr("event_id", "cast(timestamp_micros(us) as timestamp_ntz) AS ts", "event_type", "value", "'{}' AS props").coalesce(1).write.parquet(f"{folder}/events.parquet")
    return str(folder)


@pytest.mark.parametrize("name", ["jsonl_features", "storage_all_rows"])
def test_quiet_windows_exactly_as_in_sql(spark, calmed, name):
    """Whole rows of the quiet hours; in the wild ones SQL's own sums are rounded."""
    duckdb = pytest.importorskip("duckdb")
    quiet = 1_704_931_200_000_000_000 + 2 * 3600 * SECOND + 2400 * SECOND
    with duckdb.connect(config={"threads": 1}) as c:
        c.execute("SET TimeZone = 'UTC'")
        c.execute(f"CREATE VIEW events AS SELECT * FROM '{calmed}/events.parquet/*.parquet'")
        expected = sorted(r for r in c.execute(catalog.ORACLES[name]).fetchall() if r[0] >= quiet)
    assert len(expected) == 1000
    assert sorted(tuple(r) for r in catalog.QUERIES[name](spark, calmed).collect() if r["ts"] >= quiet) == expected


def test_replaced_events_are_stored_anew(spark, tmp_path):
    """A larger table under the path of a smaller one, in one session."""
    (table := tmp_path / "in" / "events.parquet").mkdir(parents=True)
    for copies in (1, 3):
        made = _tied(spark, tmp_path / str(copies), copies, n=60)
        shutil.copyfile(next(Path(made, "events.parquet").glob("*.parquet")), table / "events.parquet")
        _same_as_sql(spark, str(tmp_path / "in"), "storage_all_rows")


def test_events_without_a_type_are_stored_as_in_sql(spark, tmp_path):
    """An empty type stays apart from a null one."""
    rows = [(i, 1_704_067_200_000_000 + i * 1_000_000, ["", None, "click"][i % 3], 5.0 + i) for i in range(9)]
    events = spark.createDataFrame(rows, "event_id long, us long, event_type string, value double")
    events.selectExpr("event_id", "cast(timestamp_micros(us) as timestamp_ntz) AS ts", "event_type", "value", "'{}' AS props").coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    _same_as_sql(spark, str(tmp_path), "storage_all_rows")
