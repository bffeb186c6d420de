import contextlib
import io
import random
import struct

from pyspark.sql import functions as F

from skyload.functions.columns import double_order
from skyload.operators.spread import WIDE_BUCKETS, attach_all, hot_keys, lookup_join, prior_totals, spread_join
from skyload.operators import spread
from skyload.operators.passengers import passenger_features
from skyload.operators.staging import stage
from workbench import tables


def test_join_of_heavy_keys_and_copies(spark):
    """One key holds most rows, all exact copies; every row comes back once."""
    left = spark.createDataFrame([("hot", 1)] * 300 + [("cold", n) for n in range(20)] + [(None, 7), ("alone", 8)], "k string, v int")
    right = spark.createDataFrame([("hot", 10), ("cold", 20), ("unused", 30)], "k string, w int")
    assert hot_keys(left, ["k"], 50).collect()[0]["_parts"] == 6
    assert hot_keys(left, ["k"], 500) is None
    for how in ("left", "inner"):
        spread = spread_join(left.repartition(8), right, ["k"], how=how, limit=50)
        plain = left.join(right, ["k"], how)
        assert sorted(map(str, spread.collect())) == sorted(map(str, plain.collect()))


def test_parts_are_used(spark):
    left = spark.range(1000).select(F.lit("hot").alias("k"), "id").repartition(8)
    right = spark.createDataFrame([("hot", 10)], "k string, w int")
    with_parts = spread_join(left, right, ["k"], limit=100)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        tasks = spread_join(left, right, ["k"], limit=100).select(F.spark_partition_id()).distinct().count()
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert tasks > 3
    assert with_parts.count() == 1000


def test_rows_without_a_key_are_spread(spark):
    left = spark.range(500).select(F.lit(None).cast("string").alias("k"), "id").repartition(8)
    right = spark.createDataFrame([("a", 10)], "k string, w int")
    joined = spread_join(left, right, ["k"], limit=50)
    assert joined.count() == 500 and joined.where("w IS NOT NULL").count() == 0


def test_lookup_by_broadcast_or_spread(spark):
    left = spark.createDataFrame([("a", n) for n in range(40)] + [("b", 1), ("z", 2)], "k string, v int")
    table = spark.createDataFrame([("a", 10, 40), ("b", 20, 1)], "k string, w int, n int")
    for small in (None, 0):
        joined = lookup_join(left, table, ["k"], rows="n", limit=10, small=small)
        assert joined.columns == ["k", "v", "w"]
        assert joined.agg(F.sum("w"), F.count("*")).first() == (420, 42)
    assert "BroadcastHashJoin" in explained(lookup_join(left, stage(table), ["k"], rows="n"))


def explained(df):
    text = io.StringIO()
    with contextlib.redirect_stdout(text):
        df.explain()
    return text.getvalue()


def test_sizes_table_with_counts(spark):
    left = spark.createDataFrame([("a", n) for n in range(40)] + [("b", 1)], "k string, v int")
    counts = left.groupBy("k").agg(F.count("*").alias("n"))
    joined = spread_join(left, counts, ["k"], sizes=counts, rows=F.col("n"), limit=10)
    assert {(row["k"], row["n"]) for row in joined.collect()} == {("a", 40), ("b", 1)}
    assert joined.count() == 41


def test_attach_all_is_the_same_with_and_without_heavy_keys(spark):
    left = spark.createDataFrame([("a", n) for n in range(60)] + [("b", 1), ("c", 2)], "k string, v int")
    one = spark.createDataFrame([("a", 1), ("b", 2)], "k string, x int")
    two = spark.createDataFrame([("a", 5), ("c", 6)], "k string, y int")
    plain = attach_all(left, [one, two], ["k"])
    split = attach_all(left, [one, two], ["k"], limit=10)
    assert sorted(map(str, plain.collect())) == sorted(map(str, split.select(plain.columns).collect()))


def test_running_totals_against_brute_force(spark):
    source = random.Random(3)
    table = [(source.choice(["p", "q"]), source.choice([-5, 0, source.randint(-200_000, 1_000_000_000)]), source.randint(0, 9)) for _ in range(500)]
    df = spark.createDataFrame(table, "g string, k bigint, n bigint")
    for descending in (False, True):
        for row in prior_totals(df, ["g"], "k", {"n": F.sum("n")}, descending).collect():
            ahead = [t for t in table if t[0] == row["g"] and (t[1] > row["k"] if descending else t[1] < row["k"])]
            assert row["n_before"] == sum(t[2] for t in ahead)
            assert row["keys_before"] == len({t[1] for t in ahead})
    ungrouped = prior_totals(df, [], "k", {"n": F.sum("n")})
    for row in ungrouped.collect():
        assert row["n_before"] == sum(t[2] for t in table if t[1] < row["k"])


def test_running_totals_of_wide_keys(spark):
    """Keys over all 64 bits, in three levels of buckets."""
    source = random.Random(4)
    keys = [-(2**63), 2**63 - 1, 0, -1, 1, 1 << 42, (1 << 42) - 1, -(1 << 21)] + [source.randint(-(2**63), 2**63 - 1) for _ in range(60)] + [source.randint(-50, 50) for _ in range(60)]
    table = [(source.choice(["p", None]), source.choice(keys), source.randint(0, 9)) for _ in range(400)]
    df = spark.createDataFrame([row for row in table if row[0]], "g string, k bigint, n bigint")
    for keep in (True, False):
        for row in prior_totals(df, ["g"], "k", {"n": F.sum("n")}, widths=WIDE_BUCKETS, keep=keep).collect():
            ahead = [t for t in table if t[0] == row["g"] and t[1] < row["k"]]
            assert (row["n_before"], row["keys_before"]) == (sum(t[2] for t in ahead), len({t[1] for t in ahead}))


def test_numbers_of_doubles(spark):
    source = random.Random(5)
    edges = [0.0, -0.0, 1.0, 2.0, 0.5, 5e-324, 2.2250738585072014e-308, 2.225073858507201e-308, 1.7976931348623157e308, float("inf"), float("-inf"), float("nan")]
    near = [float(f"{m}e{e}") for e in (-320, -308, -300, -3, 0, 15, 300) for m in (1, 1.0000000000000002, 9.999999999999999)]
    powers = [2.0**e * f for e in range(-1074, 1023, 97) for f in (1, 1 + 2**-52, 1 - 2**-53)]
    values = edges + near + powers + [source.uniform(-1, 1) * 10 ** source.randint(-300, 300) for _ in range(200)]
    values += [-value for value in values]
    rows = spark.createDataFrame([(v,) for v in values] + [(None,)], "x double").select("x", double_order(F.col("x")).alias("n")).collect()
    for row in rows:
        if row["x"] is None:
            assert row["n"] is None
        elif row["x"] == row["x"]:
            bits = struct.unpack("<q", struct.pack("<d", abs(row["x"])))[0]
            assert row["n"] == (-bits if row["x"] < 0 else bits)
        else:
            assert row["n"] > struct.unpack("<q", struct.pack("<d", float("inf")))[0]


def test_rows_of_a_task_are_bounded(spark, tmp_path, monkeypatch):
    """Joined bookings come in tasks of about the wanted rows, which the aggregates on the flight keep; the rows are the same."""
    lines = spark.range(6000).selectExpr(
        "id % 1500 AS l_orderkey", "id AS l_partkey", "timestamp_ntz'1995-01-01 00:00:00' AS l_shipdate", "1.0D AS l_quantity",
        "'F' AS l_linestatus", "'R' AS l_returnflag", "1 AS l_linenumber", "0.05D AS l_discount",
    )
    lines.write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.range(1500).selectExpr("id AS o_orderkey", "timestamp_ntz'1995-01-09 00:00:00' AS o_orderdate").write.parquet(f"{tmp_path}/orders.parquet")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plain = passenger_features(tables.bookings(spark, str(tmp_path), dates=True), ["flight_id"])
        expected = sorted(map(str, plain.collect()))
        monkeypatch.setattr(spread, "TASK_ROWS", 200)
        parted = tables.bookings(spark, str(tmp_path), dates=True)
        largest = parted.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0]
        result = passenger_features(parted, ["flight_id"])
        # One shuffle for either side of the join, none for the cells, the window or the totals.
        assert explained(result).count("Exchange hashpartitioning") == 2
        assert largest <= 400
        assert sorted(map(str, result.collect())) == expected
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
