"""Joins, walks and orders over the derived boards."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import graph as G
from tidemark.operators import staleness as S
from tidemark.plans.registry import query

#: Finished tasks' edges, as the cascade walks them.
OPEN = {
    "open_reads": "SELECT r.* FROM {reads} r JOIN {tasks} t ON r.flow = t.flow AND r.task = t.task WHERE t.status IN ('complete', 'stale')",
    "open_writes": "SELECT w.* FROM {writes} w JOIN {tasks} t ON w.flow = t.flow AND w.task = t.task WHERE t.status IN ('complete', 'stale')",
    "hop_edges": "SELECT DISTINCT w.flow, w.task AS src, r.task AS dst FROM {open_writes} w JOIN {open_reads} r ON w.flow = r.flow AND w.dataset = r.dataset",
    "origins": "SELECT DISTINCT flow, dataset AS origin FROM {changes}",
    "walked": """
        SELECT flow, origin, task, min(hops) AS hops FROM (
          WITH RECURSIVE w(flow, origin, task, hops) AS (
            SELECT DISTINCT c.flow, c.origin, r.task, 1 FROM {origins} c JOIN {open_reads} r ON r.flow = c.flow AND r.dataset = c.origin
            UNION
            SELECT w.flow, w.origin, h.dst, w.hops + 1 FROM w JOIN {hop_edges} h ON h.flow = w.flow AND h.src = w.task
            WHERE w.hops < 24)
          SELECT * FROM w) GROUP BY flow, origin, task""",
    "sole": "SELECT flow, dataset, CASE WHEN count(*) = 1 THEN min(task) END AS producer FROM {writes} GROUP BY flow, dataset",
    "found_causes": """
        SELECT a.flow, a.task, a.origin AS caused_by, CASE WHEN c.unreported = 0 THEN s.producer END AS caused_by_task,
               a.hops, c.kind
        FROM {walked} a JOIN {changes} c ON c.flow = a.flow AND c.dataset = a.origin
        LEFT JOIN {sole} s ON s.flow = a.flow AND s.dataset = a.origin""",
    "primary_found": """
        SELECT flow, task, hops, caused_by, caused_by_task, kind, n_causes FROM (
          SELECT *, row_number() OVER (PARTITION BY flow, task ORDER BY hops, caused_by) AS rn,
                 count(*) OVER (PARTITION BY flow, task) AS n_causes FROM {found_causes}) WHERE rn = 1""",
}


def _cascade(e):
    return S.cause_rows(S.affected_by(e.tasks, e.reads, e.writes, e.changes), e.changes, e.writes)


@query("j1_producers_of", "SELECT flow, dataset, count(*) AS writers, min(task) AS first_writer FROM {writes} GROUP BY flow, dataset")
def _(e):
    return G.producers_of(e.writes)


@query("j2_sole_producer", "SELECT * FROM {sole}", **OPEN)
def _(e):
    return G.sole_producer(e.writes)


@query(
    "j3_readers_of_changed",
    "SELECT DISTINCT c.flow, c.dataset, r.task FROM {changes} c JOIN {reads} r ON r.flow = c.flow AND r.dataset = c.dataset",
)
def _(e):
    return G.readers_of(e.reads, e.changes.select("flow", "dataset").distinct())


@query(
    "j4_external_inputs",
    """SELECT DISTINCT flow, dataset FROM {reads} r
       WHERE NOT EXISTS (SELECT 1 FROM {writes} w WHERE w.flow = r.flow AND w.dataset = r.dataset)""",
)
def _(e):
    return G.external_inputs(e.reads, e.writes)


@query(
    "j5_every_writer_finished",
    """SELECT r.flow, r.task, r.dataset,
              CASE WHEN count(w.task) = 0 THEN 1 WHEN count(w.task) = count(*) FILTER (t.status IN ('complete', 'stale')) THEN 1 ELSE 0 END AS met
       FROM {reads} r LEFT JOIN {writes} w ON w.flow = r.flow AND w.dataset = r.dataset
       LEFT JOIN {tasks} t ON t.flow = w.flow AND t.task = w.task GROUP BY ALL""",
)
def _(e):
    met = G.every_writer(e.reads, e.writes, e.tasks, F.col("status").isin(*G.FINISHED), True)
    return met.withColumn("met", F.col("met").cast("int"))


@query(
    "g1_downstream_all_boards",
    """WITH RECURSIVE e AS MATERIALIZED (SELECT DISTINCT w.task AS src, r.task AS dst FROM {writes} w JOIN {reads} r ON w.dataset = r.dataset),
         w(origin, task, hops) AS (
           SELECT DISTINCT c.dataset, r.task, 1 FROM {changes} c JOIN {reads} r ON r.dataset = c.dataset
           UNION SELECT w.origin, e.dst, w.hops + 1 FROM w JOIN e ON e.src = w.task WHERE w.hops < 24)
       SELECT origin, task, min(hops) AS hops FROM w GROUP BY origin, task""",
)
def _(e):
    origins = e.changes.select(F.col("dataset").alias("origin"))
    return G.task_walk(e.reads, e.writes, origins)


@query("g2_staleness_cascade", "SELECT * FROM {walked}", **OPEN)
def _(e):
    return S.affected_by(e.tasks, e.reads, e.writes, e.changes)


@query("g3_merged_marks", "SELECT * FROM {primary_found}", **OPEN)
def _(e):
    return S.primary_mark(_cascade(e))


@query("g4_report_order", "SELECT flow, task, hops FROM {primary_found} ORDER BY hops, task, flow", **OPEN)
def _(e):
    nearest = S.nearest_origin(e.tasks, e.reads, e.writes, e.changes)
    return S.in_report_order(nearest.select("flow", "task", "hops"))


@query("g5_author_attribution", "SELECT flow, task, caused_by, caused_by_task, hops, kind FROM {found_causes}", **OPEN)
def _(e):
    return _cascade(e).select("flow", "task", "caused_by", "caused_by_task", "hops", "kind")


@query("g6_via_task")
def _(e):
    walked = S.affected_by(e.tasks, e.reads, e.writes, e.changes, first_via=True)
    return S.name_via(S.cause_rows(walked, e.changes, e.writes), e.writes)


REACHED = {
    "table_edges": "SELECT DISTINCT upstream, downstream FROM {lineage} WHERE starts_with(downstream, 'urn:li:dataset:') AND starts_with(upstream, 'urn:li:dataset:')",
    "reached": """
        SELECT request, asset, min(hop) AS hop FROM (
          WITH RECURSIVE w(request, asset, hop, bound) AS (
            SELECT DISTINCT s.request, s.asset, 0, coalesce(q.hops, 3) FROM {seeds} s JOIN {requests} q ON q.request = s.request
            UNION SELECT w.request, t.downstream, w.hop + 1, w.bound FROM w JOIN {table_edges} t ON t.upstream = w.asset WHERE w.hop < w.bound)
          SELECT * FROM w) GROUP BY request, asset""",
}


@query("g7_reach_within_hops", "SELECT * FROM {reached}", **REACHED)
def _(e):
    return G.reach(e.lineage, e.seeds, e.requests)


@query(
    "g8_recorded_upstreams",
    "SELECT DISTINCT a.asset, t.upstream FROM (SELECT DISTINCT asset FROM {reached}) a LEFT JOIN {table_edges} t ON t.downstream = a.asset",
    **REACHED,
)
def _(e):
    return G.recorded_upstreams(G.reach(e.lineage, e.seeds, e.requests), e.lineage)


@query(
    "g9_unknown_seeds",
    """SELECT request, asset FROM {seeds} s WHERE s.asset NOT IN (SELECT upstream FROM {lineage})
       AND s.asset NOT IN (SELECT downstream FROM {lineage})
       AND s.asset NOT IN (SELECT 'urn:li:dataset:d' || l_partkey FROM lineitem WHERE l_discount > 0.09)""",
)
def _(e):
    known = e.lineitem.filter("l_discount > 0.09").selectExpr("'urn:li:dataset:d' || l_partkey AS asset")
    return G.unknown_seeds(e.seeds, known, e.lineage).select("request", "asset")


@query(
    "g10_topological_layers",
    """WITH RECURSIVE e AS MATERIALIZED (
         SELECT DISTINCT r.flow, r.task, w.task AS before FROM {reads} r JOIN {writes} w ON w.flow = r.flow AND w.dataset = r.dataset
         WHERE r.task <> w.task),
       d(flow, task, depth) AS (
         SELECT flow, task, 0 FROM {tasks}
         UNION SELECT e.flow, e.task, d.depth + 1 FROM d JOIN e ON e.flow = d.flow AND e.before = d.task)
       SELECT flow, task, max(depth) AS wave FROM d GROUP BY flow, task""",
)
def _(e):
    nodes = e.tasks.select("flow", "task")
    return G.layers(nodes, *G.waits_for(nodes, e.reads, e.writes))


#: Waves by counting rounds: a flagged task is placed once nothing unplaced comes before it.
FLAGGED = {
    "flagged": "SELECT flow, task FROM {tasks} WHERE status = 'stale'",
    "wait_edges": """
        SELECT DISTINCT r.flow, r.task, w.task AS before FROM {reads} r
        JOIN {writes} w ON w.flow = r.flow AND w.dataset = r.dataset
        JOIN {flagged} a ON a.flow = r.flow AND a.task = r.task
        JOIN {flagged} b ON b.flow = w.flow AND b.task = w.task WHERE r.task <> w.task""",
    "wait_depth": """
        SELECT flow, task, max(depth) AS wave FROM (
          WITH RECURSIVE d(flow, task, depth) AS (
            SELECT flow, task, 0 FROM {flagged}
            UNION SELECT e.flow, e.task, d.depth + 1 FROM d JOIN {wait_edges} e ON e.flow = d.flow AND e.before = d.task
            WHERE d.depth < 64)
          SELECT * FROM d) GROUP BY flow, task""",
    # A walk that is still going after 64 steps on these boards is inside or behind a cycle.
    "waves": "SELECT flow, task, CASE WHEN wave < 64 THEN wave END AS wave FROM {wait_depth}",
}


@query("g13_rerun_waves", "SELECT * FROM {waves}", **FLAGGED)
def _(e):
    return G.rerun_waves(e.tasks, e.reads, e.writes)


#: The reads with feedback: some tasks also read what their own readers write.
LOOPED = {
    **FLAGGED,
    "reads": """
        SELECT DISTINCT flow, 't:' || k AS task, 'd:' || d AS dataset FROM {line_reads}
        UNION SELECT flow, 't:' || d AS task, 'd:' || k AS dataset FROM {line_reads} WHERE line = 2 AND returnflag = 'R'""",
}


@query("g14_cyclic_remainder", "SELECT flow, task FROM {waves} WHERE wave IS NULL", **LOOPED)
def _(e):
    back = e.line_reads.filter("line = 2 AND returnflag = 'R'").selectExpr("flow", "'t:' || d AS task", "'d:' || k AS dataset")
    return G.cyclic(G.rerun_waves(e.tasks, e.reads.union(back).distinct(), e.writes))


@query("g11_display_layers", "SELECT flow, task, coalesce(wave, (SELECT max(x.wave) FROM {waves} x WHERE x.flow = v.flow) + 1) AS layer FROM {waves} v", **LOOPED)
def _(e):
    back = e.line_reads.filter("line = 2 AND returnflag = 'R'").selectExpr("flow", "'t:' || d AS task", "'d:' || k AS dataset")
    return G.display_layers(G.rerun_waves(e.tasks, e.reads.union(back).distinct(), e.writes))


STARTABLE = """
    SELECT v.flow, v.task FROM {waves} v WHERE v.wave = 0 AND NOT EXISTS (
      SELECT 1 FROM {reads} r JOIN {writes} w ON w.flow = r.flow AND w.dataset = r.dataset
      JOIN {tasks} t ON t.flow = w.flow AND t.task = w.task
      WHERE r.flow = v.flow AND r.task = v.task AND w.task <> v.task AND t.status NOT IN ('complete', 'stale'))"""


@query("g15_startable_now", STARTABLE, **FLAGGED)
def _(e):
    return G.startable_now(G.rerun_waves(e.tasks, e.reads, e.writes), e.tasks, e.reads, e.writes)


@query(
    "g16_neighbours",
    """WITH e AS (SELECT flow, dataset AS src, task AS dst FROM {reads} UNION SELECT flow, task AS src, dataset AS dst FROM {writes})
       SELECT flow, src AS node, dst AS neighbour, 'out' AS side FROM e UNION ALL SELECT flow, dst, src, 'in' FROM e""",
)
def _(e):
    return G.neighbours(e.reads, e.writes)


@query("g12_cascade_edges")
def _(e):
    return G.cascade_edges(e.reads, e.writes, e.causes)
