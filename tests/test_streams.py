import os
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from quillgraph.operators import replay
from quillgraph.streaming import live

AT = datetime(2024, 5, 1, 12)
KIND = "sample string, ts timestamp, turn int, n int, tool string, tokens int"


def call(sample, minutes, turn, n, tool, tokens=1):
    return (sample, AT + timedelta(minutes=minutes), turn, n, tool, tokens)


@pytest.fixture(autouse=True)
def rocks(spark):
    """The state store of timers and times to live, and few partitions."""
    wanted = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider", "spark.sql.shuffle.partitions": "1"}
    old = {k: spark.conf.get(k) for k in wanted}
    for k, v in wanted.items():
        spark.conf.set(k, v)
    yield
    for k, v in old.items():
        spark.conf.set(k, v)


class Stream:
    """Batches of rows as files, one for a trigger, and a query that is stopped and started again."""

    def __init__(self, spark, tmp, form):
        self.spark, self.tmp, self.form, self.n, self.trigger = spark, tmp, form, 0, {"availableNow": True}
        (tmp / "in").mkdir()

    def run(self, *batches):
        for rows in batches:
            at = f"{self.tmp}/in/{self.n:03}.json"
            d = self.spark.createDataFrame(rows, KIND).withColumn("ts", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'"))
            with open(at, "w") as f:
                f.write("\n".join(d.toJSON().collect()))
            os.utime(at, (self.n + 1, self.n + 1))
            self.n += 1
        got = []
        s = self.spark.readStream.schema(KIND).option("maxFilesPerTrigger", 1).json(f"{self.tmp}/in")
        q = self.form(s).writeStream.foreachBatch(lambda d, i: got.extend(d.collect())).outputMode(self.mode).option("checkpointLocation", f"{self.tmp}/state").trigger(**self.trigger).start()
        assert q.awaitTermination(120) and q.exception() is None
        return got


def folded(spark, rows):
    d = replay.calls_of(spark.createDataFrame(rows, KIND), "sample", ["ts", "n"])
    s = d.select("sample", replay.budget_machine("calls").alias("s")).collect()
    return {r["sample"]: (r.s.left, r.s.ran, r.s.rejected, r.s.submitted) for r in s}


def test_budget_machine_restarts_closes_and_drops_late_rows(spark, tmp_path):
    st = Stream(spark, tmp_path, lambda s: live.budget_states(s, idle_minutes=60))
    st.mode = "update"
    a = [call("a", 0, 0, i, "read_section") for i in range(5)] + [call("b", 1, 0, 0, "think")]
    b = [call("a", 5, 1, 0, "read_section"), call("a", 5, 2, 0, "read_section"), call("a", 6, 3, 0, "read_section"), call("b", 6, 1, 0, "submit_answer")]
    c = [call("a", 8, 4, 0, "get_references"), call("b", 8, 2, 0, "think")]
    last = lambda rows: {r["sample"]: (r.left, r.ran, r.rejected, r.submitted) for r in rows}
    first = st.run(a, b)
    assert last(first) == folded(spark, a + b)
    then = st.run(c)  # another run of the query, from the checkpoint
    assert last(then) == folded(spark, a + b + c) and {r["sample"] for r in then if r.stopped} == {"a", "b"}
    far = st.run([call("c", 200, 0, 0, "think")], [call("c", 201, 0, 1, "think")], [call("c", 202, 0, 2, "think"), call("a", 9, 9, 0, "think")])
    assert last([r for r in far if r.closed]) == folded(spark, a + b + c)  # idle for an hour; the late call of a is dropped
    assert [(r["sample"], r.ran) for r in far if not r.closed] == [("c", 1), ("c", 2), ("c", 3)]
    again = st.run([call("a", 205, 0, 0, "read_section")])
    assert [(r["sample"], r.left, r.ran) for r in again if not r.closed] == [("a", 25, 1)]  # its old state is gone


def test_states_with_a_time_to_live(spark, tmp_path):
    st = Stream(spark, tmp_path, lambda s: live.budget_states(s, keep_hours=1))
    st.mode, st.trigger = "update", {"once": True}  # by the clock a query goes on for ever
    rows = [call("a", 0, 0, 0, "read_section"), call("b", 0, 0, 0, "think")]
    assert {(r["sample"], r.left) for r in st.run(rows)} == {("a", 25), ("b", 30)}
    assert {(r["sample"], r.left, r.ran) for r in st.run([call("a", -999, 1, 0, "read_section")])} == {("a", 20, 2)}


def test_sessions_and_late_rows(spark, tmp_path):
    st = Stream(spark, tmp_path, live.sessions)
    st.mode = "append"
    one = st.run([call("a", 0, 0, 0, "x", 1), call("a", 20, 0, 0, "x", 2), call("b", 0, 0, 0, "x", 5)])
    two = st.run([call("a", 45, 0, 0, "x", 4)], [call("b", 300, 0, 0, "x", 7)])
    three = st.run([call("a", 10, 0, 0, "x", 100), call("b", 310, 0, 0, "x", 1)], [call("c", 900, 0, 0, "x", 0)], [call("c", 901, 0, 0, "x", 0)])
    got = sorted((r["sample"], (r.start - AT).total_seconds() / 60, (r.end - AT).total_seconds() / 60, r.calls, r.tokens) for r in one + two + three)
    assert got == [("a", 0, 75, 3, 7), ("b", 0, 30, 1, 5), ("b", 300, 340, 2, 8)]


def test_the_machine_equals_the_fold(spark):
    import random

    rng = random.Random(4)
    rows = [call(f"s{rng.randrange(40)}", i, i // 9, i, rng.choice(["read_section", "think", "get_references", "submit_answer", "other"])) for i in range(900)]
    state = {}
    for s, _, turn, _, tool, _ in rows:
        state[s] = live.turned(state.get(s, (30, 0, 0, 0, False, False, -1)), turn, tool)
    assert {k: (v[0], v[1], v[2], v[4]) for k, v in state.items()} == folded(spark, rows)
