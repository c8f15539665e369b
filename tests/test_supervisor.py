"""The supervisor's steps, and its stream against its batch form, also after a restart from the checkpoint."""

import random
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from pagelake.operators import ledger
from pagelake.streaming import supervisor
from pagelake.streaming.supervisor import Supervisor

SCHEMA = "queue string, seq long, at long, event string, task string, status string, page int, total int, percent int, error string"


def run(s, *events):
    out = []
    for at, event, *rest in events:
        task, status, error = (*rest, None, None, None)[:3]
        out += [a[1:] for a in s.handle(SimpleNamespace(at=at, event=event, task=task, status=status, page=None, total=None, percent=None, error=error))]
    return out


def status(s):
    return {t.task: t.status for t in s.ledger.tasks}


def test_tasks_run_one_after_the_other():
    s = Supervisor()
    first = run(s, (1, "add", "a"), (2, "add", "b"))
    assert first == [("create_output", "a", "a-1.pdf"), ("run", "a", "2200")]
    assert run(s, (3, "outcome", "b", "success")) == []
    assert run(s, (4, "outcome", "a", "success")) == [("create_output", "b", "b-1.pdf"), ("run", "b", "2200")]
    assert run(s, (5, "outcome", "b", "failure", "no space")) == [("delete_output", "b", "b-1.pdf")]
    assert status(s) == {"a": "done", "b": "failed"}
    assert s.ledger.tasks[1].error == "no space" and not s.needed()


@pytest.mark.parametrize(
    ("request_", "outcome", "ends", "actions"),
    [
        ("pause", "paused", "paused", ["delete_output"]),
        ("cancel", "cancelled", "cancelled", ["delete_output", "clean_cache"]),
        ("pause", "success", "paused", []),
        (None, "error", "failed", ["delete_output"]),
    ],
)
def test_outcomes(request_, outcome, ends, actions):
    s = Supervisor()
    run(s, (1, "add", "a"))
    if request_:
        run(s, (2, request_, "a"))
    assert [a[0] for a in run(s, (3, "outcome", "a", outcome))] == actions
    assert status(s) == {"a": ends}


def test_a_silent_worker_is_dead():
    s = Supervisor(lease_ms=100)
    run(s, (0, "add", "a"), (50, "progress", "a"))
    assert s.deadline == 150
    assert run(s, (150, "add", "b")) == []
    assert run(s, (151, "add", "c")) == [("delete_output", "a", "a-1.pdf"), ("create_output", "a", "a-2.pdf"), ("run", "a", "2200")]
    assert s.deadline == 250 and s.ledger.tasks[0].crashes == 1
    run(s, (251, "add", "d"), (1000, "add", "e"))
    assert status(s)["a"] == "failed"



def test_a_restart_reclaims():
    s = Supervisor()
    run(s, (1, "add", "a"), (2, "add", "b"), (3, "outcome", "a", "success"), (4, "cancel", "b"))
    assert run(s, (5, "restart")) == [("clean_cache", "a", ""), ("delete_output", "b", "b-1.pdf"), ("clean_cache", "b", "")]
    assert status(s) == {"a": "done", "b": "cancelled"}
    again = Supervisor.load(s.dump(), s.lease_ms)
    assert again == s


def events(seed, queues, number):
    r = random.Random(seed)
    out, at = [], 1_000_000
    for seq in range(number):
        at += r.choice([1, 1000, 60_000, 400_000])
        q, t = f"q{r.randrange(queues)}", r.choice("abc")
        event = r.choice(["add", "outcome", "outcome", "outcome", "progress", "pause", "resume", "cancel", "retry", "restart", "pause_all", "resume_all"])
        out.append((q, seq, at, event, t, r.choice(list(supervisor.ENDS)) if event == "outcome" else None, 3, 9, 30, "bad" if event == "outcome" else None))
    return out


def test_stream_is_batch_also_after_a_restart(spark, tmp_path):
    rows = events(7, 4, 240)
    last = rows[-1][2]
    rows += [("clock", 1000 + i, last + i * 3_000_000, "pause_all", None, None, None, None, None, None) for i in (1, 2)]
    want = supervisor.actions(spark.createDataFrame(rows, SCHEMA), until=last + 3_000_000).orderBy("queue", "n").collect()
    assert {r["action"] for r in want} == {"create_output", "run", "delete_output", "clean_cache"}
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    source, out, place = (str(tmp_path / n) for n in ("in", "out", "checkpoint"))
    ledgers = spark.createDataFrame([("old", 0, "x", "running", 2200, 0, 0, False, 0, 0, False), ("old", 1, "y", "waiting", 2200, 0, 0, False, 0, 0, False)], ledger.STATE)

    def go():
        stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(source).withColumn("ts", F.timestamp_millis("at"))
        query = supervisor.actions_stream(stream, ledgers).writeStream.format("parquet").option("path", out).option("checkpointLocation", place).trigger(availableNow=True).start()
        query.awaitTermination(300)
        assert query.exception() is None

    parts = [rows[:80], rows[80:170], rows[170:240], rows[240:241], rows[241:]]
    try:
        for i, part in enumerate(parts):
            spark.createDataFrame([*part, *([("old", 5000, rows[0][2], "restart", None, None, None, None, None, None)] if i == 0 else [])], SCHEMA).coalesce(1).write.mode("append").parquet(source)
            if i in (1, 2, 4):
                go()  # each time a new query from the checkpoint
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    got = spark.read.parquet(out).orderBy("queue", "n").collect()
    assert [tuple(r) for r in got if r["queue"] != "old"] == [tuple(r) for r in want]
    old = [(r["action"], r["task"]) for r in got if r["queue"] == "old"]
    assert old[:2] == [("create_output", "x"), ("run", "x")]
