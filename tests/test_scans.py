"""Scans that choose files by manifest, and stored ids in key folders."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from disclosight import schema
from disclosight.operators.store import fit
from disclosight.sources import manifest, stored_keys, tables
from disclosight.workload import adapters, q_ingest

D = dt.date


@pytest.fixture(scope="module")
def several_files(spark):
    """No coalescing, so that small batches have several files."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def lines(spark, ids):
    n = F.col("id")
    frame = spark.createDataFrame([(i,) for i in ids], "id long").select(
        "id", (n / 10).cast("long").alias("filing_id"), (n % 10).cast("int").alias("sequence"), F.lit("A").alias("asset_name"),
        F.when(n % 97 == 0, None).when(n % 3 == 0, "HOT").otherwise(F.concat(F.lit("T"), (n % 50).cast("string"))).alias("ticker"), F.lit("P").alias("txn_type"),
        F.date_add(F.lit(D(2020, 1, 1)), (n % 700).cast("int")).alias("txn_date"), F.lit(D(2024, 1, 1)).alias("notification_date"),
        F.lit(1).cast("long").alias("amount_min"), F.lit("$").alias("amount_raw"), F.array().cast("array<string>").alias("quality_flags"))
    return fit(frame, schema.TRANSACTIONS)


@pytest.fixture(scope="module")
def store(spark, several_files, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("scans"))
    for number in (0, 1):
        tables.write_batch(spark, root, number, None, lambda name: manifest.write(spark, root, name, number),
                           transactions=manifest.laid_out(lines(spark, range(number * 3000, number * 3000 + 3000)), "transactions"))
    return root


def read_files(frame):
    return len(frame.inputFiles())


CASES = [({}, {"ticker": ["T7"]}), ({}, {"ticker": ["HOT"]}), ({"txn_date": ("2020-02-01", "2020-02-10")}, {"ticker": ["HOT"]}), ({}, {"filing_id": [17, 400]}),
         ({"id": (3100, 3200)}, {}), ({"id": (None, 9)}, {"ticker": ["T1", "T2", "nowhere"]}), ({"txn_date": ("2031-01-01", None)}, {}), ({}, {"ticker": ["nowhere"]})]


@pytest.mark.parametrize("ranges,keys", CASES)
def test_pruned_rows_are_those_of_the_whole_table(spark, store, ranges, keys):
    def wanted(frame):
        for c, (low, high) in ranges.items():
            frame = frame if low is None else frame.filter(F.col(c) >= low)
            frame = frame if high is None else frame.filter(F.col(c) <= high)
        for c, values in keys.items():
            frame = frame.filter(F.col(c).isin(values))
        return sorted(r["id"] for r in frame.collect())
    whole = tables.read_table(spark, store, "transactions", schema.TRANSACTIONS)
    found = manifest.pruned(spark, store, "transactions", schema.TRANSACTIONS, ranges, keys)
    assert wanted(found) == wanted(whole)


def test_few_files_are_read(spark, store):
    every = read_files(manifest.pruned(spark, store, "transactions", schema.TRANSACTIONS))
    count = lambda **how: read_files(manifest.pruned(spark, store, "transactions", schema.TRANSACTIONS, **how))
    assert every == 8
    assert count(keys={"ticker": ["T7"]}) <= 2  # one of four in each batch
    assert count(keys={"ticker": ["HOT"]}) < every
    assert count(ranges={"txn_date": ("2020-02-01", "2020-02-03")}, keys={"ticker": ["HOT"]}) <= count(keys={"ticker": ["HOT"]})
    assert count(ranges={"id": (0, 2999)}) == 4
    assert count(keys={"ticker": ["nowhere"]}) <= 1


def test_only_fixed_columns_choose_files(spark, store):
    for how in ({"keys": {"verification_note": ["x"]}}, {"keys": {"asset_name": ["A"]}}, {"ranges": {"amount_min": (1, 2)}}):
        with pytest.raises(ValueError, match="no manifest"):
            manifest.files(spark, store, "transactions", schema.TRANSACTIONS, **how)


def test_batches_without_manifest_are_read_whole(spark, several_files, tmp_path):
    root = str(tmp_path / "mixed")
    tables.write_batch(spark, root, 0, transactions=lines(spark, range(100)))
    tables.write_batch(spark, root, 1, None, lambda name: manifest.write(spark, root, name, 1), transactions=manifest.laid_out(lines(spark, range(100, 200)), "transactions"))
    # written but not committed
    lines(spark, range(900, 910)).write.parquet(f"{root}/transactions/batch_no=2/version=0")
    found = lambda: sorted(r["id"] for r in manifest.pruned(spark, root, "transactions", schema.TRANSACTIONS, {"id": (10, 150)}).filter("id between 10 and 150").collect())
    assert found() == list(range(10, 151))
    # a patch lies over pruned rows too, and a rewritten batch is read whole
    change = spark.createDataFrame([(1, 120, ["late"])], "batch_no long, id long, quality_flags array<string>")
    tables.write_patch(change, root, "transactions", ["quality_flags"])
    flags = lambda: manifest.pruned(spark, root, "transactions", schema.TRANSACTIONS, {"id": (120, 120)}).filter("id = 120").first()["quality_flags"]
    assert flags() == ["late"]
    assert tables.compact(spark, root, "transactions", schema.TRANSACTIONS) == 1
    assert flags() == ["late"] and found() == list(range(10, 151))


def test_an_empty_store_has_no_files(spark, tmp_path):
    assert manifest.pruned(spark, str(tmp_path / "none"), "transactions", schema.TRANSACTIONS, {"id": (1, 2)}).count() == 0


def filed(spark, names):
    return spark.createDataFrame([(n,) for n in names], "doc_id string")


def put(spark, root, number, names):
    frame = filed(spark, names)
    tables.write_batch(spark, root, number, {stored_keys.NAME: "key_bucket"}, filings=fit(frame, schema.FILINGS), **{stored_keys.NAME: stored_keys.of(frame)})


def test_stored_keys(spark, tmp_path):
    root = str(tmp_path / "keys")
    among = lambda names, **how: sorted(r[0] for r in stored_keys.stored_among(spark, root, filed(spark, names), schema.FILINGS, **how).collect())
    assert among(["a"]) == []
    put(spark, root, 0, [f"a{n}" for n in range(300)])
    put(spark, root, 1, [])
    put(spark, root, 2, ["b1", "b2"])
    tables.write_batch(spark, root, 3, filings=fit(filed(spark, ["old1"]), schema.FILINGS))  # wrote no keys
    filed(spark, ["never"]).select("doc_id", stored_keys.bucket().alias("key_bucket")).write.partitionBy("key_bucket").parquet(f"{root}/{stored_keys.NAME}/batch_no=9/version=0")
    asked = ["a7", "a7", "a299", "b1", "c", "old1", "never"]
    assert among(asked) == ["a299", "a7", "b1", "old1"]
    assert among(asked, before=2) == ["a299", "a7"]
    stored_keys.merge(spark, root)
    assert tables.next_batch_no(spark, root) == 4
    put(spark, root, 4, ["d1"])
    assert among([*asked, "d1"]) == ["a299", "a7", "b1", "d1", "old1"]
    assert among(asked, before=2) == ["a299", "a7"]


def test_only_touched_folders_are_read(spark, tmp_path):
    root = str(tmp_path / "touched")
    put(spark, root, 0, [f"a{n}" for n in range(2000)])
    folders = len(stored_keys.keys(spark, root).inputFiles())
    some = stored_keys.keys(spark, root, touched=[3, 20])
    assert folders >= 64 and {r[0] for r in some.select("key_bucket").distinct().collect()} == {3, 20}
    plan = some._jdf.queryExecution().toString()
    assert "PartitionFilters" in plan and "key_bucket" in plan.split("PartitionFilters")[1].split("PushedFilters")[0]


def test_columns_are_worked_out_behind_the_shuffle(spark):
    view = {"id": "k * 10", "ticker": "concat('P', k % 9)", "txn_date": "date '2024-01-01' + cast(k % 31 as int)", "notes": "repeat(cast(k as string), 40)"}
    given = spark.range(500).selectExpr("case when id % 50 <> 7 then id end as k")
    placed = manifest.laid_out(given, "transactions", view)
    assert placed.columns == list(view)
    # below the exchange there is the given column only
    lines = placed._jdf.queryExecution().executedPlan().toString().splitlines()
    moved = next(i for i, line in enumerate(lines) if "Exchange rangepartitioning" in line)
    assert "repeat" in "".join(lines[:moved]) and "repeat" not in "".join(lines[moved:])
    plain = given.selectExpr(*[f"{e} as {c}" for c, e in view.items()])
    assert sorted(placed.collect(), key=str) == sorted(plain.collect(), key=str)
    by_part = placed.withColumn("part", F.spark_partition_id()).collect()
    order = lambda r: tuple((x is not None, x) for x in (r["ticker"], r["txn_date"], r["id"]))
    for part in {r["part"] for r in by_part}:
        own = [order(r) for r in by_part if r["part"] == part]
        assert own == sorted(own)


def test_store_moves_given_columns(spark, monkeypatch, tmp_path):
    write = lambda name, rows, kinds: spark.createDataFrame(rows, kinds).write.parquet(f"{tmp_path}/{name}.parquet")
    write("region", [(0, "EUROPE")], "r_regionkey int, r_name string")
    write("nation", [(3, 0)], "n_nationkey int, n_regionkey int")
    write("customer", [(n, f"C{n}", "AUTO", 3) for n in range(5)], "c_custkey long, c_name string, c_mktsegment string, c_nationkey int")
    # an order that occurs twice, and one without a customer
    write("orders", [(n, n % 5, dt.datetime(1995, 1, 1 + n % 28)) for n in [*range(1, 30), 8]] + [(40, 99, dt.datetime(1995, 2, 1))],
          "o_orderkey long, o_custkey long, o_orderdate timestamp")
    write("part", [(n, f"part {n}") for n in range(1, 60)], "p_partkey long, p_name string")
    write("lineitem", [(n % 45, 1 + n % 57, 2, n % 7, "N", "O", dt.datetime(1996, 1, 1 + n % 28), 5.0, 900.5) for n in range(300)] + [(8, 99, 2, 1, "N", "O", dt.datetime(1996, 1, 1), 5.0, 1.0)],
          "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_returnflag string, l_linestatus string, l_shipdate timestamp, l_quantity double, l_extendedprice double")
    moved, laid = [], manifest.laid_out
    monkeypatch.setattr(manifest, "laid_out", lambda rows, *a: moved.append(set(rows.columns)) or laid(rows, *a))
    root = q_ingest.laid_out_store(spark, str(tmp_path), "moved")
    assert len(moved) == 4 and not any({"pdf_url", "verification_note", "amount_raw"} & columns for columns in moved)
    f, t = adapters.filings(spark, str(tmp_path)), adapters.transactions(spark, str(tmp_path), assets=True)
    own = f.filter("source = 'senate_efd'").select(F.col("id").alias("filing_id"))
    for name, kind, parts in (("filings", schema.FILINGS, (f.filter("source = 'senate_efd'"), f.filter("source <> 'senate_efd'"))),
                              ("transactions", schema.TRANSACTIONS, (t.join(own, "filing_id", "left_semi"), t.join(own, "filing_id", "left_anti")))):
        for number, part in enumerate(parts):
            stored = spark.read.schema(kind).parquet(f"{root}/{name}/batch_no={number}/version=0")
            assert sorted(stored.collect(), key=str) == sorted(fit(part, kind).collect(), key=str)
