"""Bursts kept up to date batch by batch, against a job over all trades."""

import datetime as dt
import random

from pyspark.sql import functions as F

from disclosight.plans import burst_log
from disclosight.sources import tables
from disclosight.streaming import bursts

D = dt.date
KIND = "txn_type string, ticker string, txn_date date, person_key string"


def plain(rows, gap=7):
    """Bursts by a loop over sorted days."""
    out, series = [], {}
    for kind, ticker, day, who in rows:
        series.setdefault((kind, ticker), []).append((day, who))
    for key, trades in series.items():
        trades.sort()
        groups = [[trades[0]]]
        for trade in trades[1:]:
            if (trade[0] - groups[-1][-1][0]).days <= gap:
                groups[-1].append(trade)
            else:
                groups.append([trade])
        out += [(*key, g[0][0], g[-1][0], (g[-1][0] - g[0][0]).days, len(g), len({w for _, w in g})) for g in groups]
    return sorted(out)


def shown(frame):
    return sorted(tuple(r)[:7] for r in frame.collect())


def test_every_batch_equals_the_full_job(spark, tmp_path):
    r = random.Random(3)
    rows = [(r.choice("PS"), r.choice(["HOT"] * 5 + [f"T{n}" for n in range(12)]), D(2024, 1, 1) + dt.timedelta(r.randrange(400)), f"p{r.randrange(9)}") for _ in range(700)]
    root, seen = str(tmp_path / "log"), []
    for number in range(4):
        part = rows[number * 175:(number + 1) * 175]
        seen += part
        for _ in range(2):  # a replay changes nothing
            burst_log.add_trades(spark, root, spark.createDataFrame(part, KIND), number)
        assert shown(burst_log.current(spark, root)) == plain(seen)
    # a failed attempt leaves nothing visible, and an empty batch changes nothing
    spark.createDataFrame([("P", "HOT", D(2020, 1, 1), "x", 1, 3)], burst_log.DAY_ROWS).drop("bucket").write.parquet(f"{root}/{burst_log.DAYS}/batch_no=4/version=0/bucket=3")
    burst_log.add_trades(spark, root, spark.createDataFrame([], KIND), 4)
    assert shown(burst_log.current(spark, root)) == plain(seen)


def test_merging_splits_nothing_and_untouched_series_stay(spark, tmp_path):
    root = str(tmp_path / "merge")
    put = lambda number, *rows: burst_log.add_trades(spark, root, spark.createDataFrame(list(rows), KIND), number)
    put(0, ("P", "A", D(2024, 1, 1), "x"), ("P", "A", D(2024, 1, 15), "y"), ("P", "B", D(2024, 1, 1), "x"), ("P", "A", D(2025, 1, 1), "x"))
    put(1, ("P", "A", D(2024, 1, 8), "x"))
    now = {(r["ticker"], r["start_date"]): r for r in burst_log.current(spark, root).collect()}
    merged = now["A", D(2024, 1, 1)]
    assert (merged["end_date"], merged["transaction_count"], merged["politician_count"], merged["revision"]) == (D(2024, 1, 15), 3, 2, 1)
    assert ("A", D(2024, 1, 15)) not in now and now["B", D(2024, 1, 1)]["revision"] == 0 and now["A", D(2025, 1, 1)]["revision"] == 0
    # the bursts of January 2024 were closed, as a trade of 2025 was known
    told = {(r["start_date"], r["retracted"]) for r in burst_log.corrections(spark, root).collect()}
    assert told == {(D(2024, 1, 1), False), (D(2024, 1, 15), True)}
    put(2, ("P", "A", D(2025, 1, 2), "z"))  # an open burst goes on: no correction
    assert burst_log.corrections(spark, root).count() == 2
    put(3, ("S", "Z", D(2025, 6, 1), "z"))
    put(4, ("P", "A", D(2025, 1, 3), "z"))  # closed meanwhile by the trades of others
    assert burst_log.corrections(spark, root).where("revision = 4").count() == 1
    written = tables.read_or_none(spark, burst_log.BURST_ROWS, f"{root}/bursts/batch_no=2")
    assert written.count() == 1


def test_only_touched_folders_are_read(spark, tmp_path):
    root = str(tmp_path / "folders")
    burst_log.add_trades(spark, root, spark.createDataFrame([("P", f"T{n}", D(2024, 1, 1), "x") for n in range(300)], KIND), 0)
    rows = burst_log.current(spark, root, touched=[5])
    assert {r[0] for r in rows.select(F.pmod(F.xxhash64("txn_type", "ticker"), F.lit(64))).distinct().collect()} == {5}
    assert len(burst_log._rows(spark, root, burst_log.DAYS, burst_log.DAY_ROWS, [5], None).inputFiles()) >= 1


def test_stream_with_late_trades(spark, tmp_path):
    kind = "txn_type string, ticker string, txn_time timestamp, person_key string"
    at = lambda *day: dt.datetime(*day)
    first = [("P", "A", at(2024, 1, 1), "x"), ("P", "A", at(2024, 12, 1), "x")]
    late = [("P", "A", at(2024, 1, 5), "y"), ("S", "A", at(2023, 5, 5), "y")]
    root, source = str(tmp_path / "log"), str(tmp_path / "in")
    for number, part in enumerate((first, late)):
        spark.createDataFrame(part, kind).write.mode("append").parquet(source)
        stream = spark.readStream.schema(kind).parquet(source)
        bursts.log_bursts(stream, root, str(tmp_path / "checkpoint")).awaitTermination()
    assert shown(burst_log.current(spark, root)) == plain([(k, t, d.date(), w) for k, t, d, w in first + late])
    assert [(r["start_date"], r["politician_count"]) for r in burst_log.corrections(spark, root).collect()] == [(D(2024, 1, 1), 2)]


def test_bursts_are_worked_out_once_per_batch(spark, tmp_path, monkeypatch):
    numbered, seen = burst_log.bursts.number_bursts, spark.sparkContext.accumulator(0)

    def counted(days, gap):
        out = numbered(days, gap)

        def count(batches):
            for batch in batches:
                seen.add(batch.num_rows)
                yield batch
        return out.mapInArrow(count, out.schema)

    monkeypatch.setattr(burst_log.bursts, "number_bursts", counted)
    rows = [("P", "T", D(2024, 1, 1) + dt.timedelta(10 * n), "a") for n in range(5)]
    burst_log.add_trades(spark, str(tmp_path / "log"), spark.createDataFrame(rows, KIND), 0)
    assert seen.value == 5
    assert shown(burst_log.current(spark, str(tmp_path / "log"))) == plain(rows)
