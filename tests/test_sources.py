"""Files, batches, storage, queries, serving and streams."""

import json
import socket
import threading
import time

import pytest
from pyspark.sql import functions as F

from tapewise.functions import day, hour, microprice, minute
from tapewise.operators import compute_features
from tapewise.plans import FeatureQueries, catalog
from tapewise.schemas import DAY, FEATURE, HOUR, MINUTE
from tapewise.serving import FeatureStore
from tapewise.sources import Replay, batch_numbers, measure_write, micro_batches, read_features, read_file, read_trades, scan_hour, socket_trades, stream_dead_letters, stream_trades, synthetic_trades, trades_from_rows, validated, write_features
from tapewise.sources.live import CLOSE, PING, TEXT, Connection, frame, trade
from tapewise.streaming import stream_features

B = 1_700_000_000_000_000_000


def feature_rows(spark, n=120):
    i = F.col("id")
    null = F.lit(None).cast("double")
    return spark.range(n).select((F.lit(B) + i * MINUTE).alias("ts"), F.element_at(F.array(F.lit("AAA"), F.lit("BBB"), F.lit("007")), (i % 3 + 1).cast("int")).alias("symbol"), (30000 + i * 0.5).alias("vwap_1m"), null.alias("vwap_5m"), (30000 + i * 0.5).alias("vwap_15m"), ((i % 10) * 1e-5).alias("rv_1m"), F.lit(0.0).alias("rv_5m"), ((i % 10) - 5).cast("double").alias("ofi_1m"), null.alias("microprice"), (i % 50 + 1).alias("trade_count_1m"))


@pytest.fixture(scope="module")
def base(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("features") / "base")
    write_features(feature_rows(spark), path)
    return path


def test_json_lines(spark, tmp_path):
    rows = [{"ts": B + i, "symbol": "X", "price": 1.0, "qty": 2.0, "side": "buy", "seq": i} for i in range(3)]
    (tmp_path / "a.jsonl").write_text("\n\n".join(json.dumps(r) for r in rows) + "\n")
    assert read_trades(spark, str(tmp_path / "a.jsonl")).count() == 3
    (tmp_path / "empty.jsonl").write_text("")
    assert read_trades(spark, str(tmp_path / "empty.jsonl")).count() == 0
    (tmp_path / "bad.jsonl").write_text(json.dumps({**rows[0], "side": "hold"}))
    with pytest.raises(Exception, match="not a trade"):
        read_trades(spark, str(tmp_path / "bad.jsonl")).collect()
    (tmp_path / "broken.jsonl").write_text("{")
    assert read_trades(spark, str(tmp_path / "broken.jsonl"), dead_letters=True).collect()[0]["_corrupt_record"] == "{"
    assert validated(spark.read.json(str(tmp_path / "bad.jsonl")), reject=False).count() == 0


def lines_of(rows):
    return "".join(json.dumps(dict(zip(("ts", "symbol", "price", "qty", "side"), r))) + "\n" for r in rows)


def test_lines_without_seq_are_numbered(spark, tmp_path):
    """File by file and line by line, also where a file is read in many blocks."""
    rows = [(B + (i * 7919 % 500) * 10**9, "X", 1.0 + i, 1.0, "buy") for i in range(3000)]
    for k in range(3):
        (tmp_path / f"part-{k}.jsonl").write_text(lines_of(rows[k * 1000 : (k + 1) * 1000]).replace("\n", "\n\n" if k == 1 else "\n"))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20k")
    try:
        got = read_trades(spark, str(tmp_path)).orderBy("seq").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert [r["price"] for r in got] == [r[2] for r in rows] and len({r["seq"] for r in got}) == 3000
    few = [(B + t * 10**9, "S", 1.0, 1.0, "buy") for t in (0, 10, 9, 7, 8)]
    (tmp_path / "few.jsonl").write_text(lines_of(few))
    for mode in ("event_time", "arrival"):
        assert compute_features(read_trades(spark, str(tmp_path / "few.jsonl")), mode).count() == 4
    assert compute_features(read_trades(spark, str(tmp_path / "few.jsonl")), "arrival").filter("trade_count_1m = 3").first()["ts"] == B + 9 * 10**9


@pytest.mark.parametrize("mode", ["event_time", "arrival"])
def test_trades_without_seq_are_an_error(spark, mode):
    rows = trades_from_rows(spark, [(B, "S", 1.0, 1.0, "buy")]).withColumn("seq", F.lit(None).cast("long"))
    with pytest.raises(Exception, match="no seq"):
        compute_features(rows, mode).collect()


def test_streams_pass_over_bad_lines(spark, tmp_path):
    good = [(B + t * 10**9, "S", 1.0, 1.0, "buy") for t in range(5)]
    bad = ["{", '{"ts": 1}', json.dumps({"ts": B, "symbol": "S", "price": 1.0, "qty": 1.0, "side": "hold"})]
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.jsonl").write_text(lines_of(good[:3]) + "\n".join(bad) + "\n\n" + lines_of(good[3:]))
    stream = stream_trades(spark, str(tmp_path / "in"), number_lines=True)
    stream_features(stream, str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out")).orderBy("ts").collect()
    assert [(r["ts"], r["trade_count_1m"], r["ofi_1m"]) for r in got] == [(g[0], i + 1, i + 1.0) for i, g in enumerate(good)]
    letters = stream_dead_letters(spark, str(tmp_path / "in")).writeStream.format("memory").queryName("letters").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "check2")).start()
    letters.awaitTermination()
    assert sorted(r["value"] for r in spark.table("letters").collect()) == sorted(bad)
    assert sorted(r["_corrupt_record"] for r in read_trades(spark, str(tmp_path / "in"), dead_letters=True).filter("_corrupt_record IS NOT NULL").collect()) == sorted(bad)


def test_micro_batches(spark, tmp_path):
    seen = []
    (tmp_path / "in").mkdir()
    for k in range(3):
        (tmp_path / "in" / f"{k}.jsonl").write_text(lines_of([(B + k, "S", 1.0, 1.0, "buy")] * 2))
    micro_batches(stream_trades(spark, str(tmp_path / "in"), max_files=1), lambda batch, n: seen.append(batch.count()), str(tmp_path / "check"), drain=True).awaitTermination()
    assert [n for n in seen if n] == [2, 2, 2]


def test_socket_and_replay(spark, tmp_path):
    """A file served over a WebSocket comes in as a stream, in its order, bad messages aside."""
    rows = [(B + i * 10**8, "S", 100.0 + i, 1.0, "buy" if i % 2 else "sell") for i in range(40)]
    text = lines_of(rows)
    (tmp_path / "a.jsonl").write_text(text[: text.index("\n") + 1] + "no trade\n" + text[text.index("\n") + 1 :])
    with Replay(str(tmp_path / "a.jsonl"), speed=20.0) as server:
        stream = socket_trades(spark, server.url, max_rows=15)
        query = stream.writeStream.format("memory").queryName("live").option("checkpointLocation", str(tmp_path / "check")).start()
        try:
            for _ in range(120):
                if query.exception() or spark.table("live").count() >= 40:
                    break
                time.sleep(0.5)
        finally:
            query.stop()
    got = spark.table("live").orderBy("seq").collect()
    assert [(r["ts"], r["symbol"], r["price"], r["qty"], r["side"]) for r in got] == rows and [r["seq"] for r in got] == list(range(40))


def test_frames():
    """Long, cut, masked and control frames."""
    a, b = socket.socketpair()
    left, right = Connection(a, True), Connection(b, False)
    for body in (b"x", b"y" * 300, b"z" * 70_000):
        threading.Thread(target=left.send, args=(TEXT, body)).start()
        assert next(right.messages(time.monotonic() + 5)) == body
    a.sendall(bytes([TEXT, 2]) + b"ab" + frame(PING, b"hi", True) + bytes([0x80, 1]) + b"c" + frame(CLOSE, b"", True))
    assert list(right.messages(time.monotonic() + 5)) == [b"abc"] and not right.open
    assert list(left.messages(time.monotonic() + 0.2)) == [] and left.open
    assert trade(b'{"ts": 1, "symbol": "S", "price": 2, "qty": 3, "side": "buy"}') == (1, "S", 2.0, 3.0, "buy", None, None, None, None)
    assert trade(b"[]") is None and trade(b'{"ts": 1}') is None and trade(b"{") is None


def test_batches(spark):
    sizes = lambda n, k: [r["count"] for r in batch_numbers(synthetic_trades(spark, n), k).groupBy("batch").count().orderBy("batch").collect()]
    assert sizes(10, 5) == [5, 5] and sizes(7, 5) == [5, 2] and sizes(0, 5) == []


def test_columns(spark):
    r = spark.range(1).select(day(F.lit(B)).alias("d"), hour(F.lit(B)).alias("h"), *[minute(F.lit(B + s * 10**9)).alias(f"m{s}") for s in (20, 30, 79)], microprice(*(F.lit(float(x)) for x in (99, 2, 101, 1))).alias("p"), microprice(F.lit(1.0), F.lit(0.0), F.lit(1.0), F.lit(0.0)).alias("z")).first()
    assert (r["d"], r["h"]) == (19675, 22)
    assert [r["m20"], r["m30"], r["m79"]] == [(B + s * 10**9) // MINUTE * MINUTE for s in (20, 30, 79)]
    assert r["p"] == pytest.approx(100.33333333333333) and r["z"] is None


def test_storage(spark, base, tmp_path):
    rows = read_features(spark, base)
    assert rows.columns == FEATURE.names and rows.count() == 120
    assert read_features(spark, base, symbol="007").count() == 40
    d = B // DAY
    assert read_features(spark, base, date_from=d, date_to=d).count() + read_features(spark, base, date_from=d + 1).count() == 120
    files = [f.rsplit("/", 1)[0] for f in spark.read.parquet(base).inputFiles()]
    assert len(files) == len(set(files))
    plan = read_features(spark, base, symbol="AAA", date_from=d)._jdf.queryExecution().toString()
    assert "PartitionFilters" in plan
    again = str(tmp_path / "again")
    for _ in range(2):
        write_features(feature_rows(spark, 10), again, overwrite=True)
    assert read_features(spark, again).count() == 10
    assert measure_write(feature_rows(spark, 10), str(tmp_path / "m"))["rows_written"] == 10


@pytest.mark.parametrize("name", ["storage_roundtrip", "storage_all_rows", "storage_filtered_read"])
def test_storage_queries_store_all_rows(spark, tmp_path, monkeypatch, name):
    duckdb = pytest.importorskip("duckdb")
    folder = "/root/testdata/sf0.001"
    monkeypatch.setattr(catalog, "_base", lambda _: str(tmp_path / "all"))
    monkeypatch.setattr(catalog, "_kept", {})
    got = catalog.QUERIES[name](spark, folder)
    every = catalog._features(spark, folder).select(*FEATURE.names).collect()
    assert sorted(map(str, read_features(spark, str(tmp_path / "all")).collect())) == sorted(map(str, every))
    db = duckdb.connect()
    db.execute(f"CREATE VIEW events AS SELECT * FROM '{folder}/events.parquet'")
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, db.execute(catalog.ORACLES[name]).fetchall()))


def test_any_symbol_is_read_back(spark, tmp_path):
    """Also those whose folders Spark would read as null, or whose names look like a mark of the folders."""
    base, symbols = str(tmp_path / "symbols"), ["", None, "__HIVE_DEFAULT_PARTITION__", "\x01", "\x01A", "A", "a=b/c"]
    rows = feature_rows(spark, len(symbols)).withColumn("symbol", F.element_at(F.array(*map(F.lit, symbols)), ((F.col("ts") - B) / MINUTE + 1).cast("int")))
    write_features(rows, base)
    assert sorted(map(str, read_features(spark, base).collect())) == sorted(map(str, rows.select(*FEATURE.names).collect()))
    for k, s in enumerate(symbols):
        if s is not None:
            assert [r["ts"] for r in read_features(spark, base, symbol=s).collect()] == [B + k * MINUTE]
            assert [r["symbol"] for r in scan_hour(spark, base, s, B + k * MINUTE).filter(F.col("ts") == B + k * MINUTE).collect()] == [s]


def test_queries_agree(spark, base):
    q = FeatureQueries(spark, base)
    for name, frame, params in (
        ("q1", q.q1_vwap_per_minute("AAA", B), {"symbol": "AAA", "cutoff": B}), ("q2", q.q2_top_symbols(B), {"cutoff": B}), ("q3", q.q3_rv_distribution(B + HOUR), {"cutoff": B + HOUR}),
        ("q4", q.q4_point_lookup("AAA", B), {"symbol": "AAA", "ts": B}), ("q5", q.q5_ofi_momentum("AAA", B), {"symbol": "AAA", "cutoff": B}),
    ):
        rows = frame.collect()
        assert rows == q.canonical(name, **params).collect() and rows
    assert [r["minute_ts"] % MINUTE for r in q.q1_vwap_per_minute("AAA", B).collect()] == [0] * 40
    assert q.q4_point_lookup("AAA", B + 1).count() == 0


def test_serving(spark, base):
    s = FeatureStore(spark, base)
    assert s.health()["cache_rows"] == 0
    assert s.lookup("AAA", B)["source"] == "cache" and s.lookup("AAA", B + 1) is None
    cold = FeatureStore(spark, base, most_rows=0)
    assert cold.lookup("AAA", B)["source"] == "parquet" and cold.health()["status"] == "ok"
    assert cold.lookup("AAA", B + 10 * DAY) is None and scan_hour(spark, base, "AAA", B + 10 * DAY) is None
    files = scan_hour(spark, base, "AAA", B).inputFiles()
    assert len(files) == 1 and "symbol=AAA" in files[0] and read_file(spark, files[0]).count() >= 1


def test_of_one_instant_the_last_trade_is_served(spark, tmp_path):
    odd = "a/b=c d"
    write_features(compute_features(trades_from_rows(spark, [(B, odd, 1.0, 1.0, "buy"), (B, odd, 3.0, 1.0, "buy"), (B, odd, 5.0, 1.0, "sell")])), str(tmp_path / "one"))
    hot, cold = FeatureStore(spark, str(tmp_path / "one")), FeatureStore(spark, str(tmp_path / "one"), most_rows=0)
    assert hot.lookup(odd, B)["source"] == "cache" and cold.lookup(odd, B)["source"] == "parquet"
    assert hot.lookup(odd, B)["trade_count_1m"] == cold.lookup(odd, B)["trade_count_1m"] == 3


def test_stream_equals_batch(spark, tmp_path):
    source, out, check = (str(tmp_path / x) for x in ("in", "out", "check"))
    rows = synthetic_trades(spark, 400)
    rows.filter("seq < 200").coalesce(1).write.json(source)
    stream_features(stream_trades(spark, source), out, check).awaitTermination()
    rows.filter("seq >= 200").coalesce(1).write.mode("append").json(source)
    stream_features(stream_trades(spark, source), out, check).awaitTermination()  # resumes from its state
    got = {r["ts"]: r for r in spark.read.parquet(out).collect()}
    want = compute_features(rows, "event_time").collect()
    assert len(got) == len(want) == 400
    for r in want:
        for c in ("vwap_1m", "vwap_15m", "rv_5m", "ofi_1m"):
            assert got[r["ts"]][c] == pytest.approx(r[c], abs=1e-9)
        assert got[r["ts"]]["trade_count_1m"] == r["trade_count_1m"] and got[r["ts"]]["late_drop_total"] == 0


def test_stream_counts_late(spark, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    trades_from_rows(spark, [(B + t * 10**9, "S", 1.0, 1.0, "buy") for t in (0, 10, 9, 7, 8)]).coalesce(1).write.json(source)
    stream_features(stream_trades(spark, source), out, str(tmp_path / "check")).awaitTermination()
    assert {(r["ts"] - B) // 10**9: (r["trade_count_1m"], r["late_drop_total"]) for r in spark.read.parquet(out).collect()} == {0: (1, 1), 10: (2, 1), 9: (3, 1), 8: (4, 1)}
