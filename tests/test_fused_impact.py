"""The impact moves to the frame that the query's SQL takes, also where two accelerations differ by rounding only."""

import datetime as dt

import duckdb
from conftest import canonical

from motionlake import catalog

# frame, x, y of a ball whose accelerations at the frames 361 and 362 are one number but for rounding
BALL = ((351, 10.0, 9), (352, 10.0, 57), (355, 10.0, 43), (356, 0.0, 44), (357, 30.0, 15), (358, 0.0, 12), (362, 10.0, 35), (363, 10.0, 18), (365, 0.0, 4), (366, 40.0, 49), (367, 10.0, 68), (368, 10.0, 59))


def test_frames_of_like_acceleration(spark, tmp_path):
    rows = []
    for clip, last in enumerate(range(708, 720)):
        for frame, value, k in (*BALL, (last, 1.0, 1)):
            rows.append((len(rows), dt.datetime(2024, 1, 1) + dt.timedelta(hours=frame), clip * 10, "view", value, f'{{"k": {k}}}'))
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string").write.parquet(f"{tmp_path}/events.parquet")
    con = duckdb.connect()
    con.sql(f"create view events as select * from '{tmp_path}/events.parquet/*.parquet'")
    got = catalog.queries()["d_fuse_impact"](spark, str(tmp_path)).toPandas()
    assert got.fused.any()
    assert canonical(got) == canonical(con.sql(catalog.oracle_sql()["d_fuse_impact"]).df())
