"""Restoration, readiness, freshness and the board rollups."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import board as B
from tidemark.operators import graph as G
from tidemark.plans.graph_queries import FLAGGED, STARTABLE
from tidemark.plans.registry import query

#: One decision per board: the last marked task to have finished redoes its tables identically.
DECIDED = {
    "marked": "SELECT DISTINCT flow, task FROM {causes}",
    "decision": """
        SELECT flow, max_by(task, (finished_at, task)) AS finishing FROM {tasks} JOIN {marked} USING (flow, task)
        WHERE finished_at IS NOT NULL GROUP BY flow""",
    "unchanged": "SELECT w.flow, w.dataset FROM {writes} w JOIN {decision} d ON d.flow = w.flow AND d.finishing = w.task",
    "cand": """
        SELECT t.flow, t.task, d.finishing, t.finished_at AS read_at FROM {tasks} t JOIN {decision} d ON d.flow = t.flow
        JOIN {marked} m ON m.flow = t.flow AND m.task = t.task
        WHERE t.status = 'stale' AND t.finished_at IS NOT NULL AND t.task <> d.finishing""",
    "ground": """
        SELECT c.flow, c.task, w.task AS writer, coalesce(t.finished_at <= c.read_at, false) AND n.task IS NULL AND z.task IS NULL AS sound,
               w.task = c.finishing OR t.status = 'complete' AS settled
        FROM {cand} c JOIN {reads} r ON r.flow = c.flow AND r.task = c.task
        JOIN {writes} w ON w.flow = r.flow AND w.dataset = r.dataset
        JOIN {tasks} t ON t.flow = w.flow AND t.task = w.task
        LEFT JOIN (SELECT * FROM {fps} WHERE slot = 'observed') n ON n.flow = w.flow AND n.task = w.task AND n.dataset = r.dataset
        LEFT JOIN (SELECT DISTINCT flow, task, caused_by FROM {causes}) z ON z.flow = c.flow AND z.task = c.task AND z.caused_by = r.dataset""",
    "r0": """
        SELECT flow, task FROM {cand} c WHERE NOT EXISTS (SELECT 1 FROM {ground} g WHERE g.flow = c.flow AND g.task = c.task AND NOT (g.sound AND g.settled))""",
}
ROUNDS = 8
for _n in range(1, ROUNDS + 1):
    DECIDED[f"r{_n}"] = f"""
        SELECT flow, task FROM {{cand}} c WHERE NOT EXISTS (
          SELECT 1 FROM {{ground}} g LEFT JOIN {{r{_n - 1}}} k ON k.flow = g.flow AND k.task = g.writer
          WHERE g.flow = c.flow AND g.task = c.task AND NOT (g.sound AND (g.settled OR k.task IS NOT NULL)))"""


def decision(e):
    last = e.tasks.filter("finished_at IS NOT NULL").join(e.causes, ["flow", "task"], "left_semi")
    return last.groupBy("flow").agg(F.max_by("task", F.struct("finished_at", "task")).alias("finishing"))


@query("o10_restored", f"SELECT flow, task FROM {{r{ROUNDS}}}", **DECIDED)
def _(e):
    chosen = decision(e)
    same = e.writes.join(chosen.withColumnRenamed("finishing", "task"), ["flow", "task"]).select("flow", "dataset")
    return B.restored_by(e.tasks, e.reads, e.writes, e.causes, e.fps, chosen, same).select("flow", "task")


@query("o11_firing_decisions", "SELECT DISTINCT flow, finishing FROM {decision} JOIN {unchanged} USING (flow)", **DECIDED)
def _(e):
    chosen = decision(e)
    same = e.writes.join(chosen.withColumnRenamed("finishing", "task"), ["flow", "task"]).select("flow", "dataset")
    return B.firing(chosen, e.causes, same)


UNMET = """SELECT 1 FROM {reads} r JOIN {writes} w ON w.flow = r.flow AND w.dataset = r.dataset
    JOIN {tasks} b ON b.flow = w.flow AND b.task = w.task
    WHERE r.flow = t.flow AND r.task = t.task AND b.status NOT IN ('complete', 'stale')"""


@query("o12_ready_to_start", f"SELECT flow, task FROM {{tasks}} t WHERE status = 'registered' AND NOT EXISTS ({UNMET})")
def _(e):
    return B.ready_to_start(e.tasks, e.reads, e.writes)


@query(
    "o13_blocked",
    """SELECT r.flow, r.task, r.dataset, b.name AS waiting_on FROM {tasks} t JOIN {reads} r ON r.flow = t.flow AND r.task = t.task
       JOIN {writes} w ON w.flow = r.flow AND w.dataset = r.dataset JOIN {tasks} b ON b.flow = w.flow AND b.task = w.task
       WHERE t.status = 'registered' AND b.status NOT IN ('complete', 'stale')""",
)
def _(e):
    return B.blocked(e.tasks, e.reads, e.writes)


@query(
    "o14_freshness",
    """WITH w AS (SELECT w.flow, w.dataset, count(*) AS n, min(CASE t.status WHEN 'stale' THEN 0 WHEN 'running' THEN 1 WHEN 'complete' THEN 3 ELSE 2 END) AS worst
                 FROM {writes} w JOIN {tasks} t ON t.flow = w.flow AND t.task = w.task GROUP BY 1, 2)
       SELECT r.flow, r.dataset, coalesce(n, 0) AS writers, CASE WHEN worst IS NULL THEN 'no-registered-producer' WHEN worst = 0 THEN 'stale'
              WHEN worst = 1 THEN 'in-flight' WHEN worst = 2 THEN 'not-yet-produced' ELSE 'fresh' END AS verdict
       FROM (SELECT DISTINCT flow, dataset FROM {reads}) r LEFT JOIN w ON w.flow = r.flow AND w.dataset = r.dataset""",
)
def _(e):
    return B.freshness(e.reads, e.tasks, e.writes)


@query(
    "o15_prior_status",
    """SELECT t.flow, t.task, CASE WHEN m.task IS NOT NULL THEN 'stale' WHEN t.finished_at IS NOT NULL AND f.task IS NOT NULL THEN 'complete' ELSE 'registered' END AS prior_status
       FROM {tasks} t LEFT JOIN {marked} m ON m.flow = t.flow AND m.task = t.task
       LEFT JOIN (SELECT DISTINCT flow, task FROM {fps} WHERE slot = 'current') f ON f.flow = t.flow AND f.task = t.task""",
    **DECIDED,
)
def _(e):
    return B.prior_status(e.tasks, e.causes, e.fps)


@query(
    "b1_totals",
    """WITH g AS (SELECT flow, task, max(CASE WHEN tag = 'stale_work' THEN 1 ELSE 0 END) AS tagged FROM {tags} GROUP BY 1, 2)
       SELECT t.flow, count(*) AS tasks, count(*) FILTER (status IN ('complete', 'stale')) AS finished, count(*) FILTER (status = 'stale') AS stale,
              count(m.task) AS marked, count(*) FILTER (m.task IS NOT NULL AND tagged = 1) AS tagged,
              count(*) FILTER (m.task IS NULL AND tagged = 1) AS left_over
       FROM {tasks} t LEFT JOIN {marked} m ON m.flow = t.flow AND m.task = t.task
       LEFT JOIN g ON g.flow = t.flow AND g.task = t.task GROUP BY 1""",
    **DECIDED,
)
def _(e):
    return B.totals(e.tasks, e.causes, e.tags)


MARKS = {
    "lead": """
        SELECT flow, task, caused_by, caused_by_task, hops, since, n_causes FROM (
          SELECT c.*, row_number() OVER (PARTITION BY c.flow, c.task ORDER BY c.hops, c.caused_by) AS rn,
                 count(*) OVER (PARTITION BY c.flow, c.task) AS n_causes
          FROM {causes} c JOIN {tasks} t ON t.flow = c.flow AND t.task = c.task WHERE t.status = 'stale') WHERE rn = 1""",
    "newest": """
        SELECT flow, caused_by, caused_by_task, since FROM (
          SELECT *, row_number() OVER (PARTITION BY flow ORDER BY since DESC, caused_by, task) AS rn FROM {lead}) WHERE rn = 1""",
}


@query("b2_current_change", "SELECT * FROM {newest}", **MARKS)
def _(e):
    return B.current_change(B.primary_marks(e.tasks, e.causes))


@query(
    "b3_detection_timing",
    """SELECT l.flow, max(m.detected_ms) FILTER (m.detected_ms >= 0) AS ms, t.name AS source, count(*) AS flagged
       FROM {newest} n JOIN {lead} l ON l.flow = n.flow AND l.caused_by_task = n.caused_by_task
       LEFT JOIN {tasks} t ON t.flow = n.flow AND t.task = n.caused_by_task
       LEFT JOIN {measured} m ON m.flow = l.flow AND m.task = l.task
       GROUP BY l.flow, t.name HAVING max(m.detected_ms) FILTER (m.detected_ms >= 0) IS NOT NULL""",
    **MARKS,
)
def _(e):
    return B.detection_timing(B.primary_marks(e.tasks, e.causes), e.tasks, e.measured)


@query("b4_last_report", "SELECT flow, max(greatest(finished_at, started_at)) AS last_report FROM {tasks} GROUP BY 1")
def _(e):
    return B.last_report_at(e.tasks)


@query(
    "b5_status_counts",
    """SELECT flow, count(*) FILTER (status = 'registered') AS n_registered, count(*) FILTER (status = 'running') AS n_running,
              count(*) FILTER (status = 'complete') AS n_complete, count(*) FILTER (status = 'stale') AS n_stale FROM {tasks} GROUP BY 1""",
)
def _(e):
    return B.status_counts(e.tasks)


@query(
    "b5_trimmed_board",
    """SELECT t.flow, t.task, t.name, t.status, l.caused_by, l.n_causes FROM {tasks} t LEFT JOIN {lead} l ON l.flow = t.flow AND l.task = t.task""",
    **MARKS,
)
def _(e):
    return B.trimmed_board(e.tasks, B.primary_marks(e.tasks, e.causes))


@query("b6_rows_written", "SELECT task, CAST(sum(row_count) AS BIGINT) AS rows_written FROM {shapes} GROUP BY 1")
def _(e):
    return B.rows_written(e.shapes)


@query(
    "b7_output_columns",
    """SELECT task, string_agg(column_name, ',' ORDER BY dataset, pos, column_name) AS columns FROM (
         SELECT task, column_name, min((dataset, pos)) AS s, s[1] AS dataset, s[2] AS pos FROM {shape_columns} GROUP BY 1, 2) GROUP BY 1""",
)
def _(e):
    return B.output_columns(e.shape_columns)


@query(
    "b8_table_diff",
    """WITH s AS (SELECT l_orderkey, l_linestatus AS side, count(*) AS n, list_sort(list(DISTINCT 'col_' || l_returnflag || l_linenumber)) AS c FROM lineitem GROUP BY 1, 2)
       SELECT 'd:' || b.l_orderkey AS dataset, array_to_string(list_filter(a.c, lambda x: NOT list_contains(b.c, x)), ',') AS added,
              array_to_string(list_filter(b.c, lambda x: NOT list_contains(a.c, x)), ',') AS removed, b.n AS rows_before, a.n AS rows_after
       FROM s b JOIN s a ON a.l_orderkey = b.l_orderkey WHERE b.side = 'F' AND a.side = 'O'""",
)
def _(e):
    name = F.concat(F.lit("col_"), "l_returnflag", F.col("l_linenumber").cast("string"))

    def side(status):
        kept = e.lineitem.filter(F.col("l_linestatus") == status)
        return kept.groupBy(F.concat(F.lit("d:"), F.col("l_orderkey").cast("string")).alias("dataset")).agg(
            F.count(F.lit(1)).alias("row_count"), F.array_sort(F.collect_set(name)).alias("columns")
        )

    return B.table_diff(side("F"), side("O")).select(
        "dataset", F.array_join("added", ",").alias("added"), F.array_join("removed", ",").alias("removed"), "rows_before", "rows_after"
    )


@query(
    "b9_rerun_summary",
    f"""WITH s AS (SELECT flow, count(*) AS startable FROM ({STARTABLE}) GROUP BY 1)
        SELECT v.flow, count(*) AS flagged, coalesce(max(wave) + 1, 0) AS waves, count(*) FILTER (wave IS NULL) AS cyclic, coalesce(max(startable), 0) AS startable
        FROM {{waves}} v LEFT JOIN s ON s.flow = v.flow GROUP BY v.flow""",
    **FLAGGED,
)
def _(e):
    waves = G.rerun_waves(e.tasks, e.reads, e.writes)
    return B.rerun_summary(waves, G.startable_now(waves, e.tasks, e.reads, e.writes))


@query(
    "b10_repair_cost",
    """SELECT flow, count(*) AS flagged, CASE WHEN count(run_ms) = count(*) THEN CAST(sum(run_ms) AS BIGINT) END AS estimate_ms
       FROM {tasks} WHERE status = 'stale' GROUP BY 1""",
)
def _(e):
    return B.repair_cost(e.tasks)


@query("b12_missing_tasks", "SELECT pos, task FROM {expected} WHERE task NOT IN (SELECT task FROM {tasks})")
def _(e):
    return B.missing_tasks(e.expected, e.tasks).select("pos", "task")


@query(
    "b13_has_baseline",
    """SELECT o.report, o.flow, o.task, o.dataset, CASE WHEN f.task IS NULL THEN 0 ELSE 1 END AS has_baseline
       FROM {report_outputs} o LEFT JOIN {fps} f ON f.flow = o.flow AND f.task = o.task AND f.dataset = o.dataset AND f.slot = 'current'""",
)
def _(e):
    return B.has_baseline(e.report_outputs.select("report", "flow", "task", "dataset"), e.fps)


@query("b14_stale_tagged", "SELECT flow, task, max(CASE WHEN tag = 'stale_work' THEN 1 ELSE 0 END) AS tagged FROM {tags} GROUP BY 1, 2")
def _(e):
    return B.stale_tagged(e.tags)


@query("s6_board_scan", "SELECT flow, task, status FROM {tasks} WHERE removed = 0")
def _(e):
    return B.board_scan(e.tasks, e.reads.select("flow", "task"))[0].select("flow", "task", "status")


@query(
    "s6_board_disagreement",
    "SELECT DISTINCT flow, task FROM {report_outputs} o WHERE NOT EXISTS (SELECT 1 FROM {recorded} r WHERE r.flow = o.flow AND r.task = o.task)",
)
def _(e):
    members = e.report_outputs.select("flow", "task").distinct()
    recorded = e.recorded.withColumn("removed", F.lit(0))
    return B.board_scan(recorded, members)[1]


@query(
    "t7_in_flight",
    """SELECT flow, task, CASE WHEN status = 'running' AND epoch_ms(TIMESTAMP '1999-06-30') >= epoch_ms(started_at)
              THEN epoch_ms(TIMESTAMP '1999-06-30') - epoch_ms(started_at) END AS in_flight_ms FROM {tasks}""",
)
def _(e):
    return B.in_flight_ms(e.tasks, F.lit("1999-06-30").cast("timestamp"))
