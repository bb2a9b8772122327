"""Streams go on where they stopped, and nothing arriving is no error."""

from pyspark.sql import functions as F

from quarrymill.plans.listing_queries import STAMP, stored_and_batch
from quarrymill.streaming import jobs

from .conftest import SMALL


def test_upserts_go_on_where_they_stopped(spark, tmp_path):
    stored, batch = stored_and_batch(spark, SMALL)
    path, folder = str(tmp_path / "in"), str(tmp_path / "state")
    cut = F.pmod(F.xxhash64("uid"), F.lit(3)) == 0
    spark.createDataFrame([], batch.schema).write.parquet(path)
    open_stream = lambda: spark.readStream.schema(batch.schema).parquet(path)
    plain = lambda df: sorted(map(str, df.select("uid", "title", "first_seen", "last_seen", "feedback").collect()))
    assert plain(jobs.upsert_stream(open_stream(), stored, STAMP, folder)) == plain(stored)
    batch.filter(cut).write.mode("append").parquet(path)
    jobs.upsert_stream(open_stream(), stored, STAMP, folder)
    batch.filter(~cut).write.mode("append").parquet(path)
    parted = plain(jobs.upsert_stream(open_stream(), stored.limit(0), STAMP, folder))
    assert parted == plain(jobs.L.upsert(stored, batch, STAMP)) and parted != plain(stored)
    assert plain(jobs.upsert_stream(open_stream(), stored.limit(0), STAMP, folder)) == parted


def test_sessions_end_and_go_on(spark, tmp_path):
    path, folder = str(tmp_path / "in"), str(tmp_path / "state")
    schema = "user string, ts timestamp"
    spark.createDataFrame([], schema).write.parquet(path)

    def arrive(*rows):
        if rows:
            spark.createDataFrame([(u, t) for u, t in rows], "user string, t string").select("user", F.col("t").cast("timestamp").alias("ts")).coalesce(1).write.mode("append").parquet(path)
        got = jobs.session_stream(spark.readStream.schema(schema).parquet(path), "user", "ts", folder=folder)
        return sorted((r["user"], str(r["started"]), r["n"]) for r in got.collect())

    assert arrive() == []
    assert arrive(("a", "2024-01-01 00:00:00"), ("a", "2024-01-01 10:00:00"), ("b", "2024-01-01 01:00:00")) == []
    assert arrive(("a", "2024-01-01 20:00:00"), ("b", "2024-01-03 00:00:00")) == [("a", "2024-01-01 00:00:00", 3), ("b", "2024-01-01 01:00:00", 1)]
    assert arrive(("c", "2024-01-09 00:00:00"))[-1] == ("b", "2024-01-03 00:00:00", 1)
    assert len(arrive()) == 3


def test_snapshots_go_on_where_they_stopped(spark, tmp_path):
    path, folder = str(tmp_path / "in"), str(tmp_path / "state")
    schema = "id string, at string, status string, http_status int, text string, page_title string, page_updated string, error string"
    spark.createDataFrame([], schema).write.parquet(path)

    def arrive(*rows):
        if rows:
            spark.createDataFrame([(*r, None) for r in rows], schema).coalesce(1).write.mode("append").parquet(path)
        index, versions = jobs.snapshot_stream(spark.readStream.schema(schema).parquet(path), folder)
        return {r["id"]: r for r in index.collect()}, sorted((r["id"], r["valid_from"], r["valid_to"], r["outcome"], r["text"]) for r in versions.collect())

    assert arrive() == ({}, [])
    index, versions = arrive(("a", "1", "ok", 200, "one", "A", "2024-01-01"), ("a", "2", "error", 500, None, None, None), ("b", "1", "blocked", 403, None, None, None), ("a", "3", "ok", 200, "one", "A3", None))
    assert versions == [("a", "1", None, "new", "one")]
    a, b = index["a"], index["b"]
    assert (a["first_seen"], a["changed_at"], a["last_ok"], a["last_checked"], a["status"], a["page_title"], a["page_updated"], a["chars"]) == ("1", "1", "3", "3", "ok", "A3", None, 3)
    assert (b["content_hash"], b["first_seen"], b["last_ok"], b["last_checked"], b["status"], b["http_status"]) == (None, None, None, "1", "blocked", 403)
    index, versions = arrive(("a", "4", "ok", 200, "two", "A", None), ("a", "5", "ok", 200, "one", "A", None), ("a", "6", "error", 500, None, None, None), ("b", "6", "ok", 200, "bee", "B", None))
    assert versions == [("a", "1", "4", "new", "one"), ("a", "4", "5", "changed", "two"), ("a", "5", None, "changed", "one"), ("b", "6", None, "new", "bee")]
    a = index["a"]
    assert (a["first_seen"], a["changed_at"], a["last_ok"], a["last_checked"], a["status"], a["page_title"], a["http_status"]) == ("1", "5", "5", "6", "error", "A", 500)
    assert arrive() == (index, versions)
    _, log = jobs.snapshot_stream(spark.readStream.schema(schema).parquet(path), folder)
    held = lambda at: sorted((r["id"], r["text"]) for r in jobs.as_of(log, at).collect())
    assert (held("0"), held("4"), held("6")) == ([], [("a", "two")], [("a", "one"), ("b", "bee")])
    kept = [p.name for p in (tmp_path / "state/index/rows").glob("v*/_part=*")]
    assert len(kept) <= 4  # versions that later ones have replaced go
