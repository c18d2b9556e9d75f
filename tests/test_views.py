from datetime import datetime

import duckdb
import pytest

from sheaf.plans import queries


@pytest.mark.parametrize("zone", ["UTC", "America/New_York"])
def test_rests_are_counted_in_whole_seconds_of_the_clock(spark, tmp_path, zone):
    """Six hours and 0.3 s are over 21,600 s where a second ends between; also before 1970 and where the session's clock is put forward."""
    times = ["2024-01-01 00:00:00.9", "2024-01-01 06:00:01.2", "2024-01-01 12:00:01.9", "1969-12-31 18:00:00.5", "1970-01-01 00:00:00.6", "2024-03-10 01:59:59.5", "2024-03-10 02:30:00.1", "2024-03-10 08:00:00.4"]
    kinds = ["click", "buy", "view", "buy", "error", "buy", "click", "buy"]
    rows = [(k, datetime.fromisoformat(t), k // 4, kind) for k, (t, kind) in enumerate(zip(times, kinds))]
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string").write.parquet(f"{tmp_path}/events.parquet")
        db = duckdb.connect()
        db.execute(f"create view events as select * from '{tmp_path}/events.parquet/*.parquet'")
        for name in ("doc_ids", "spans", "page_prf", "panoptic_quality", "mndd"):
            got = queries.QUERIES[name](spark, str(tmp_path)).collect()
            assert sorted(map(tuple, got)) == sorted(db.execute(queries.ORACLE_SQL[name]).fetchall()), name
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)
