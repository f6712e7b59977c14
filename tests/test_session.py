"""Session settings."""

from __future__ import annotations

from datetime import datetime

from mercadia import registry
from mercadia.session import ADVISORY, TASK_BYTES, WIDTH, scale_conf, sized_session, task_conf


def test_scale_conf_sizes_shuffle_width():
    assert scale_conf(10 ** 6)["spark.sql.shuffle.partitions"] == "200"
    assert scale_conf(10 * 2 ** 40)["spark.sql.shuffle.partitions"] == "10240"
    assert scale_conf(100 * 2 ** 40)["spark.sql.shuffle.partitions"] == "102400"
    c = scale_conf(2 ** 40)
    assert c["spark.sql.files.maxPartitionBytes"] == str(256 << 20)
    assert c["spark.sql.adaptive.advisoryPartitionSizeInBytes"] == str(256 << 20)


def test_width_follows_the_input_and_finer_settings_stay(spark):
    for gb in (1, 6, 100):
        conf = task_conf(spark, gb << 30)
        assert int(conf[WIDTH]) * TASK_BYTES >= gb << 30
        assert conf[ADVISORY] == f"{TASK_BYTES}b"
    assert task_conf(spark, 1)[WIDTH] == spark.conf.get(WIDTH)
    assert task_conf(spark, 100 << 40)[WIDTH] == str(100 << 10)
    old = spark.conf.get(ADVISORY)
    spark.conf.set(ADVISORY, "1k")
    try:
        assert task_conf(spark, 1 << 30)[ADVISORY] == "1024b"
    finally:
        spark.conf.set(ADVISORY, old)


def test_sized_session_keeps_its_settings_at_every_call(spark):
    before = dict(spark.conf.getAll)
    for _ in range(3):
        sized = sized_session(spark, "/some/folder", 64 * TASK_BYTES)
        assert sized.conf.get(WIDTH) == "64" and sized.conf.get(ADVISORY) == f"{TASK_BYTES}b"
        assert sized.conf.get("spark.sql.session.timeZone") == spark.conf.get("spark.sql.session.timeZone")
    assert dict(spark.conf.getAll) == before
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "77")
    try:
        assert sized_session(spark, "/some/folder", 1).conf.get("spark.sql.autoBroadcastJoinThreshold") == "77"
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    again = sized_session(spark, "/some/folder", 1)
    assert again.conf.get("spark.sql.autoBroadcastJoinThreshold") != "77"
    assert again.conf.get(WIDTH) == spark.conf.get(WIDTH)


def test_queries_run_as_wide_as_their_tables_need(spark, scratch, monkeypatch):
    """A task's share of the input stays the same when the tables grow."""
    day = datetime(1995, 1, 1)
    lines = [(o, n, 1, 1 + n, day, 10.0, 0.1) for o in range(50) for n in range(3)]
    spark.createDataFrame(lines, "l_orderkey long, l_linenumber long, l_partkey long, l_suppkey long, "
                          "l_shipdate timestamp_ntz, l_extendedprice double, l_tax double"
                          ).write.parquet(f"{scratch}/lineitem.parquet")
    for size in (100, 600):
        monkeypatch.setattr(registry, "input_bytes", lambda *_: size * TASK_BYTES)
        df = registry.QUERIES["seller_revenue"](spark, scratch)
        assert df.sparkSession.conf.get(WIDTH) == str(size)
        assert {(r.seller_id, r.total_orders) for r in df.collect()} == {(1, 50), (2, 50), (3, 50)}
