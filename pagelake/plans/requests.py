"""Queries of task queues under all kinds of requests, of undo logs, and of the supervisor."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagelake.operators import bindings as B
from pagelake.operators import ink, ledger
from pagelake.plans.registry import query
from pagelake.streaming import supervisor

#: Events as requests, by k % 13.
REQUESTS = ["add", "claim", "pause", "resume", "cancel", "retry", "pause_all", "resume_all", "progress", "finish", "crash", "discard", "remove"]
ENDS = ["done", "failed", "paused", "cancelled"]


def _requests(spark, sf) -> DataFrame:
    """A user is a queue of tasks t0 to t3."""
    e = B.read(spark, sf, "events").withColumn("k", F.get_json_object("props", "$.k").cast("int"))
    kind = F.get(F.array(*map(F.lit, REQUESTS)), F.col("k") % 13)
    event = F.when(F.col("event_type") == "signup", "add").when(F.col("event_type") == "view", "claim").otherwise(kind)
    rows = e.select(
        F.col("user_id").cast("string").alias("queue"), F.col("event_id").alias("seq"), F.unix_millis(F.col("ts").cast("timestamp")).alias("at"), event.alias("event"), F.concat(F.lit("t"), F.col("k") % 4).alias("task"),
        F.when(event == "finish", F.get(F.array(*map(F.lit, ENDS)), (F.col("event_id") % 4).cast("int"))).alias("status"), F.col("k").alias("page"), F.lit(100).alias("total"), F.col("k").alias("percent"),
    )
    return ledger.with_event_columns(rows)


_FIELDS = ["task", "status", "quality", "page", "progress", "held", "crashes", "crashed"]


def _task(**changes: str) -> str:
    return "{" + ", ".join(f"'{f}': {changes.get(f, f'x.{f}')}" for f in _FIELDS) + "}"


_ZERO, _NO = "CAST(0 AS INTEGER)", "CAST(0 AS BIGINT)"
_CALM = {"crashes": _ZERO, "crashed": _NO}
_STRIKE = f"least(CASE WHEN x.crashed > 0 AND ms - x.crashed BETWEEN 0 AND {ledger.CRASH_GAP_MS} THEN x.crashes ELSE 0 END + 1, {ledger.CRASHES})"
#: What each request does to the task that it names.
_NAMED = {
    "pause": f"WHEN x.status IN ('running', 'waiting', 'pausing', 'paused') THEN {_task(status="CASE x.status WHEN 'running' THEN 'pausing' WHEN 'waiting' THEN 'paused' ELSE x.status END", held='false')}",
    "resume": f"WHEN x.status IN ('paused', 'failed') THEN {_task(status="'waiting'", held='false', **_CALM)}",
    "retry": f"WHEN x.status IN ('cancelled', 'failed') THEN {_task(status="'waiting'", held='false', **_CALM)}",
    "cancel": f"WHEN true THEN {_task(status="CASE WHEN x.status IN ('running', 'pausing') THEN 'cancelling' WHEN x.status IN ('waiting', 'paused', 'failed') THEN 'cancelled' ELSE x.status END", held='false')}",
    "progress": f"WHEN x.status = 'running' THEN {_task(page='k', progress='least(greatest(k, 0), 100)')}",
    "discard": f"WHEN x.status IN ('waiting', 'paused', 'failed') THEN {_task(status="'cancelled'", held='false', page=_ZERO, progress=_ZERO, **_CALM)}",
    "finish": f"""WHEN x.status = 'pausing' THEN {_task(status="'paused'", **_CALM)} WHEN x.status = 'cancelling' THEN {_task(status="'cancelled'", held='false', **_CALM)}
        WHEN x.status = 'running' AND told = 'paused' AND NOT paused THEN {_task(status="'waiting'", held='false')} WHEN told = 'done' THEN {_task(status='told', held='false', progress='CAST(100 AS INTEGER)', **_CALM)}
        WHEN told = 'paused' THEN {_task(status='told', **_CALM)} WHEN told = 'cancelled' THEN {_task(status='told', held='false', **_CALM)} WHEN told = 'failed' THEN {_task(status='told', held='false')}""",
}
_FIRST = "list_position(list_transform(tasks, lambda y: y.task), name)"
_EACH = " ".join(f"WHEN '{event}' THEN list_transform(tasks, lambda x, n: CASE WHEN n IS DISTINCT FROM {_FIRST} THEN x {cases} ELSE x END)" for event, cases in _NAMED.items())
_NEW = "{'task': name, 'status': 'waiting', 'quality': CAST(CASE WHEN k = 0 THEN 2200 ELSE least(greatest(k, 1200), 3200) END AS INTEGER), 'page': CAST(0 AS INTEGER), 'progress': CAST(0 AS INTEGER), 'held': false, 'crashes': CAST(0 AS INTEGER), 'crashed': CAST(0 AS BIGINT)}"
_BUSY = "len(list_filter(tasks, lambda x: x.status IN ('running', 'pausing', 'cancelling'))) > 0"


@query(
    f"""WITH RECURSIVE ev AS (SELECT CAST(user_id AS VARCHAR) AS queue, CASE event_type WHEN 'signup' THEN 'add' WHEN 'view' THEN 'claim' ELSE list_extract({REQUESTS}, CAST(k % 13 + 1 AS INTEGER)) END AS event, 't' || (k % 4) AS name, list_extract({ENDS}, CAST(event_id % 4 + 1 AS INTEGER)) AS told,
        k, epoch_ns(ts) // 1000000 AS ms, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events)),
    qs AS (
        SELECT DISTINCT queue, CAST(0 AS BIGINT) AS i, false AS paused, (SELECT list({_NEW})[1:0] FROM (SELECT name, k FROM ev LIMIT 1)) AS tasks FROM ev
        UNION ALL
        SELECT ev.queue, ev.i, CASE event WHEN 'pause_all' THEN true WHEN 'resume_all' THEN false ELSE paused END, CASE event
            WHEN 'add' THEN list_append(tasks, {_NEW})
            WHEN 'claim' THEN CASE WHEN paused OR {_BUSY} THEN tasks ELSE list_transform(tasks, lambda x, n: CASE WHEN n = list_position(list_transform(tasks, lambda y: y.status), 'waiting') THEN {_task(status="'running'", held='false')} ELSE x END) END
            {_EACH}
            WHEN 'pause_all' THEN list_transform(tasks, lambda x: CASE WHEN x.status = 'running' THEN {_task(status="'pausing'", held='true')} ELSE x END)
            WHEN 'resume_all' THEN list_transform(tasks, lambda x: CASE WHEN x.held AND x.status IN ('paused', 'pausing') THEN {_task(status="CASE x.status WHEN 'paused' THEN 'waiting' ELSE 'running' END", held='false')} ELSE x END)
            WHEN 'crash' THEN list_transform(tasks, lambda x: CASE x.status WHEN 'pausing' THEN {_task(status="'paused'", **_CALM)} WHEN 'cancelling' THEN {_task(status="'cancelled'", **_CALM)}
                WHEN 'running' THEN {_task(status=f"CASE WHEN {_STRIKE} = {ledger.CRASHES} THEN 'failed' ELSE 'waiting' END", crashes=f'CAST({_STRIKE} AS INTEGER)', crashed='CAST(ms AS BIGINT)')} ELSE x END)
            WHEN 'remove' THEN list_filter(tasks, lambda x, n: n IS DISTINCT FROM {_FIRST} OR x.status IN ('running', 'pausing', 'cancelling'))
            ELSE tasks END
        FROM qs JOIN ev ON ev.queue = qs.queue AND ev.i = qs.i + 1)
    SELECT queue, CAST(ord AS INTEGER) AS ord, x.task AS task, x.status AS status, x.quality AS quality, x.page AS page, x.progress AS progress, x.held AS paused_by_global, x.crashes AS crashes, x.crashed AS crashed_at, paused AS paused_all
    FROM (SELECT queue, paused, unnest(tasks) AS x, unnest(range(0, len(tasks))) AS ord FROM (SELECT * FROM qs QUALIFY row_number() OVER (PARTITION BY queue ORDER BY i DESC) = 1))"""
)
def queue_requests(spark, sf):
    """Queues after all kinds of requests: global pauses, retries, reported ends, discards, removals."""
    return ledger.final_states(_requests(spark, sf))


@query(
    "WITH t AS (SELECT o_custkey AS q, o_orderkey AS ord, CASE o_orderstatus WHEN 'F' THEN 'done' WHEN 'O' THEN CASE WHEN o_orderkey % 5 = 0 THEN 'waiting' ELSE 'paused' END ELSE CASE WHEN o_orderkey % 3 = 0 THEN 'running' ELSE 'failed' END END AS status FROM orders) "
    "SELECT CAST(q AS VARCHAR) AS queue, min(CASE WHEN status = 'waiting' THEN ord END) AS ord FROM t GROUP BY q HAVING NOT bool_or(status = 'running' OR q % 7 = 0) AND count(*) FILTER (WHERE status = 'waiting') > 0"
)
def next_tasks(spark, sf):
    """The task that each idle queue would run next."""
    status = F.when(F.col("o_orderstatus") == "F", "done").when(F.col("o_orderstatus") == "O", F.when(F.col("o_orderkey") % 5 == 0, "waiting").otherwise("paused")).otherwise(F.when(F.col("o_orderkey") % 3 == 0, "running").otherwise("failed"))
    tasks = B.read(spark, sf, "orders").select(F.col("o_custkey").cast("string").alias("queue"), F.col("o_orderkey").alias("ord"), status.alias("status"), (F.col("o_custkey") % 7 == 0).alias("paused_all"))
    return ledger.claimable(tasks).select("queue", "ord")


#: The states of a page's strokes are lists of names; an edit that changes nothing is none.
_VALUE = "CASE WHEN event_type IN ('click', 'signup') THEN list_append(now, 's' || (k % 3)) WHEN event_type = 'purchase' THEN ['s' || (k % 3)] ELSE now END"


@query(
    f"""WITH RECURSIVE ev AS (SELECT user_id, event_type, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i FROM events),
    st AS (
        SELECT DISTINCT user_id, CAST(0 AS BIGINT) AS i, CAST([] AS VARCHAR[]) AS now, CAST([] AS VARCHAR[][]) AS undo, CAST([] AS VARCHAR[][]) AS redo FROM ev
        UNION ALL
        SELECT user_id, i, CASE WHEN event_type = 'view' AND len(undo) > 0 THEN undo[-1] WHEN event_type = 'error' AND len(redo) > 0 THEN redo[-1] WHEN event_type IN ('view', 'error') THEN now ELSE new END,
               CASE WHEN event_type = 'view' THEN CASE WHEN len(undo) > 0 THEN undo[1:len(undo) - 1] ELSE undo END WHEN event_type = 'error' THEN CASE WHEN len(redo) > 0 THEN list_append(undo, now)[greatest(1, len(undo) + 2 - {ink.HISTORY}):] ELSE undo END
                    WHEN new = now THEN undo ELSE list_append(undo, now)[greatest(1, len(undo) + 2 - {ink.HISTORY}):] END,
               CASE WHEN event_type = 'view' THEN CASE WHEN len(undo) > 0 THEN list_append(redo, now)[greatest(1, len(redo) + 2 - {ink.HISTORY}):] ELSE redo END WHEN event_type = 'error' THEN CASE WHEN len(redo) > 0 THEN redo[1:len(redo) - 1] ELSE redo END
                    WHEN new = now THEN redo ELSE CAST([] AS VARCHAR[][]) END
        FROM (SELECT ev.user_id, ev.i, event_type, now, undo, redo, {_VALUE} AS new FROM st JOIN ev ON ev.user_id = st.user_id AND ev.i = st.i + 1))
    SELECT CAST(user_id AS VARCHAR) AS fingerprint, coalesce(list_aggregate(now, 'string_agg', ','), '') AS value, len(undo) > 0 AS can_undo, len(redo) > 0 AS can_redo FROM (SELECT * FROM st QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY i DESC) = 1)"""
)
def edit_states(spark, sf):
    """The strokes of each page after edits, undo and redo."""
    e = B.read(spark, sf, "events").withColumn("k", F.get_json_object("props", "$.k").cast("int"))
    op = F.when(F.col("event_type").isin("click", "signup"), "append").when(F.col("event_type") == "purchase", "replace").when(F.col("event_type") == "view", "undo").otherwise("redo")
    edits = e.select(F.col("user_id").cast("string").alias("fingerprint"), F.lit(0).alias("page_index"), F.col("event_id").alias("seq"), op.alias("op"), F.when(op.isin("append", "replace"), F.array(F.concat(F.lit("s"), F.col("k") % 3))).alias("value"))
    return ink.edit_history(edits).select("fingerprint", F.array_join("value", ",").alias("value"), "can_undo", "can_redo")


@query()
def supervisor_actions(spark, sf):
    """What the supervisor does for each queue; tests hold its stream form against it."""
    e = B.read(spark, sf, "events").withColumn("k", F.get_json_object("props", "$.k").cast("int"))
    event = F.when(F.col("event_type") == "signup", "add").when(F.col("event_type").isin("purchase", "view"), "outcome").when(F.col("event_type") == "error", "restart").otherwise(F.when(F.col("k") % 2 == 0, "pause").otherwise("resume"))
    status = F.when(event == "outcome", F.get(F.array(*map(F.lit, supervisor.ENDS)), F.col("k") % len(supervisor.ENDS)))
    rows = e.select(F.col("user_id").cast("string").alias("queue"), F.col("event_id").alias("seq"), F.unix_millis(F.col("ts").cast("timestamp")).alias("at"), event.alias("event"), F.concat(F.lit("t"), F.col("k") % 4).alias("task"), status.alias("status"), F.col("k").alias("page"))
    return supervisor.actions(rows, lease_ms=6 * 60 * 60 * 1000)
