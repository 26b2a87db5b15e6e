import datetime as dt

from pyspark.sql import functions as F

from tabsense.operators import catalog as R


def test_history_order_same_second(spark):
    ts = dt.datetime(2024, 1, 1, 12, 0, 0)
    msgs = spark.createDataFrame([(i, "s1", "user", f"m{i}", ts) for i in range(5)], R.CONVERSATIONS)
    first = R.history_first(msgs, "session_id", ["timestamp", "id"]).orderBy("pos").collect()
    assert [r["content"] for r in first] == [f"m{i}" for i in range(5)]
    recent = R.history_recent(msgs, "session_id", "id", 2).orderBy("pos").collect()
    assert [r["content"] for r in recent] == ["m3", "m4"]


def test_insert_or_ignore(spark):
    ex = spark.createDataFrame([("s1", None, None, {"a": "1"})], R.SESSIONS)
    inc = spark.createDataFrame([("s1", None, None, {"a": "2"}), ("s2", None, None, {})], R.SESSIONS)
    out = {r["id"]: r for r in R.upsert_ignore(ex, inc).collect()}
    assert out["s1"]["settings"] == {"a": "1"} and "s2" in out


def test_cascade_delete(spark):
    sessions = spark.createDataFrame([("s2", None, None, {})], R.SESSIONS)
    datasets = spark.createDataFrame([("d1", "s2", "a.csv", "/x/a.csv", "csv", 1, 1, {"a": "int64"}, None)],
                                     R.DATASETS)
    models = spark.createDataFrame([("m1", "s9", "d1", "classification", "rf", "y", ["a"], {"accuracy": 1.0},
                                     "/m", None)], R.MODELS)
    out = R.delete_sessions({"sessions": sessions, "datasets": datasets, "models": models},
                            spark.createDataFrame([("s2",)], "id string"))
    assert out["datasets"].where(F.col("id") == "d1").count() == 0
    assert out["models"].count() == 0          # its dataset went with the session


def test_touch_and_latest(spark):
    t0, t1 = dt.datetime(2024, 1, 1), dt.datetime(2024, 2, 1)
    sessions = spark.createDataFrame([("s1", t0, t0, {}), ("s2", t0, t0, {})], R.SESSIONS)
    touches = spark.createDataFrame([("s1", t1)], "session_id string, ts timestamp")
    got = {r["id"]: r["updated_at"] for r in R.touch(sessions, touches).collect()}
    assert got["s1"] == t1 and got["s2"] == t0
