import datetime
import random

import pytest

from strandmill.streaming import counts as stream


@pytest.mark.parametrize("buckets", [1, 1 << 14])
def test_users_share_a_state(spark, tmp_path, monkeypatch, buckets):
    """calls and states are as many as buckets at most, not as users; users without an id count as one, as in the batch query."""
    monkeypatch.setattr(stream, "BUCKETS", buckets, raising=False)
    start = datetime.datetime(2024, 1, 1)
    users = [None, 0, 1, 2, 3, -5]
    rows = [(k, start + datetime.timedelta(minutes=k * k % 977), users[k % 6], "abc"[k % 7 % 3]) for k in range(120)]
    rows += [(k, t, u, "c") for k, t, u, _ in rows[:12]]  # the same number and time twice
    want = []
    for user in users:
        own = sorted((t, k, e) for k, t, u, e in rows if u == user)
        want += [(str(user), round((b[0] - a[0]).total_seconds() / 86400, 9)) for a, b in zip(own, own[1:], strict=False)]
    rows.append((500, None, 1, "a"))  # at no time
    random.Random(1).shuffle(rows)
    kind = "event_id long, ts timestamp, user_id long, event_type string"
    for k in range(0, len(rows), 45):
        spark.createDataFrame(rows[k : k + 45], kind).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    for day in (3, 9):  # what is held goes by timeouts, the last of it when nobody sends any more
        spark.createDataFrame([(-1, start + datetime.timedelta(days=day), -1, "")], kind).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    events = spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    got = stream.run_available(stream.late_transitions(events, "2 days"), "append", str(tmp_path / "out")).collect()
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
    got = [r for r in got if r.family != -1]  # the events of nobody's
    assert sorted((str(r.family), round(r.t, 9)) for r in got) == sorted(want)
