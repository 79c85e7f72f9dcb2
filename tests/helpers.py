"""Hand-made micro traces for pytest."""

from datetime import datetime, timedelta

from trailfold.sources.readers import land_events

BASE = datetime(2024, 1, 1)
SCHEMA = ("experiment string, timestamp timestamp, RuleName string, parent_guid string, child_guid string, "
          "parent_name string, child_name string, shard_id int, file_pos long")


def trace(spark, rows, experiment="e1"):
    """rows: (t_seconds, rule, parent, child, child_name); file order = list order."""
    data = [(experiment, BASE + timedelta(seconds=t), r, p, c, None, n, 0, i)
            for i, (t, r, p, c, n) in enumerate(rows)]
    return land_events(spark.createDataFrame(data, SCHEMA))


def det(t=0.0, child="root"):
    return (t, "detonation", None, child, "sample.exe")


def pc(parent, child, t=1.0):
    return (t, "process_create", parent, child, f"{child}.exe")


def one(df):
    rows = df.collect()
    assert len(rows) == 1, rows
    return rows[0]
