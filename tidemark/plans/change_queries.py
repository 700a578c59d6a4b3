"""Change detection, admission, observations and the state that follows a report."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import change as C
from tidemark.operators import staleness as S
from tidemark.plans.graph_queries import OPEN
from tidemark.plans.registry import query
from tidemark.session import materialize

KIND = """CASE WHEN {0} IS NULL THEN NULL WHEN {0} <> {2} AND {1} <> {3} THEN 'both'
    WHEN {0} <> {2} THEN 'schema' WHEN {1} <> {3} THEN 'content' END"""


def kind(*columns: str) -> str:
    return KIND.format(*columns)


COMPARED = {
    "cur": "SELECT flow, task, dataset, schema_fp AS cs, content_fp AS cc FROM {fps} WHERE slot = 'current'",
    "prev": "SELECT flow, task, dataset, schema_fp AS ps, content_fp AS pc FROM {fps} WHERE slot = 'previous'",
    "obsv": "SELECT flow, task, dataset, schema_fp AS os, content_fp AS oc FROM {fps} WHERE slot = 'observed'",
    "compared": f"""
        SELECT r.*, {kind("cs", "cc", "r.schema_fp", "r.content_fp")} AS kind,
               CASE WHEN cs IS NULL THEN 'first' WHEN cs = r.schema_fp AND cc = r.content_fp THEN 'identical' ELSE 'changed' END AS outcome
        FROM {{report_outputs}} r LEFT JOIN {{cur}} c ON c.flow = r.flow AND c.task = r.task AND c.dataset = r.dataset""",
}


@query("c1_compare_fingerprints", "SELECT report, flow, task, dataset, schema_fp, content_fp, kind, outcome FROM {compared}", **COMPARED)
def _(e):
    return C.compare_outputs(e.report_outputs, e.fps)


@query(
    "c2_split_outputs",
    "SELECT report, outcome, count(*) AS outputs FROM {compared} WHERE outcome <> 'first' GROUP BY report, outcome",
    **COMPARED,
)
def _(e):
    split = C.compare_outputs(e.report_outputs, e.fps).filter("outcome <> 'first'")
    return split.groupBy("report", "outcome").agg(F.count(F.lit(1)).alias("outputs"))


def column_sides(e):
    name = F.concat(F.lit("col_"), "l_returnflag", F.col("l_linenumber").cast("string"))
    return e.lineitem.groupBy("l_orderkey").agg(
        F.collect_set(F.when(F.col("l_linestatus") == "F", name)).alias("before"),
        F.collect_set(F.when(F.col("l_linestatus") == "O", name)).alias("after"),
    )


@query(
    "c3_column_change",
    """WITH s AS (SELECT l_orderkey, list(DISTINCT 'col_' || l_returnflag || l_linenumber) FILTER (l_linestatus = 'F') AS b,
                 list(DISTINCT 'col_' || l_returnflag || l_linenumber) FILTER (l_linestatus = 'O') AS a FROM lineitem GROUP BY 1),
            d AS (SELECT l_orderkey, list_sort(list_filter(coalesce(a, []), lambda x: NOT list_contains(coalesce(b, []), x))) AS p,
                         list_sort(list_filter(coalesce(b, []), lambda x: NOT list_contains(coalesce(a, []), x))) AS m FROM s)
       SELECT l_orderkey, CASE WHEN len(p) + len(m) > 0 THEN array_to_string(p, ',') END AS added,
              CASE WHEN len(p) + len(m) > 0 THEN array_to_string(m, ',') END AS removed FROM d""",
)
def _(e):
    moved = column_sides(e).select("l_orderkey", C.column_change(F.col("before"), F.col("after")).alias("c"))
    return moved.select(
        "l_orderkey",
        F.array_join("c.added", ",").alias("added"),
        F.array_join("c.removed", ",").alias("removed"),
    )


@query(
    "c4_evidence_admission",
    """WITH c AS (SELECT o.report, count(*) AS n, count(*) FILTER (w.task IS NULL) AS bad, min(o.dataset) FILTER (w.task IS NULL) AS f
            FROM {report_outputs} o LEFT JOIN {writes} w ON w.flow = o.flow AND w.task = o.task AND w.dataset = o.dataset GROUP BY 1)
       SELECT r.report, r.flow, r.task, coalesce(bad, 0) AS undeclared,
              CASE WHEN n IS NULL THEN 'no fingerprint was reported' WHEN bad > 0 THEN 'not declared as written: ' || f END AS problem
       FROM {reports} r LEFT JOIN c ON c.report = r.report""",
)
def _(e):
    return C.admit(e.reports, e.report_outputs, e.writes)


@query(
    "c5_input_admission",
    """SELECT flow, task, dataset FROM {report_outputs} o WHERE NOT EXISTS (
         SELECT 1 FROM {reads} r WHERE r.flow = o.flow AND r.task = o.task AND r.dataset = o.dataset)""",
)
def _(e):
    return C.undeclared_inputs(e.report_outputs, e.reads).select("flow", "task", "dataset")


@query(
    "c6_output_contract",
    """SELECT count(*) AS row_count, count(*) FILTER (NOT list_contains(json_keys(props), 'k')) AS rows_lacking,
              count(*) FILTER (len(json_keys(props)) > 1) AS rows_extra, CAST(NULL AS VARCHAR) AS problem FROM events""",
)
def _(e):
    return C.validate_contract(e.events, "props", ["k"])


def odd(was: str, now: str, member: str) -> str:
    cols = f"flow, task, {member}"
    return (
        f"SELECT flow, task FROM ((SELECT {cols} FROM {was} EXCEPT SELECT {cols} FROM {now})"
        f" UNION (SELECT {cols} FROM {now} EXCEPT SELECT {cols} FROM {was}))"
    )


@query(
    "c7_same_declaration",
    f"""WITH odd AS ({odd("{reads}", "{declared_reads}", "dataset")} UNION {odd("{volatile}", "{declared_volatile}", "column_name")})
       SELECT d.flow, d.task, CASE WHEN r.task IS NOT NULL AND r.title = d.title AND o.task IS NULL THEN 1 ELSE 0 END AS same
       FROM {{declared}} d LEFT JOIN {{recorded}} r ON r.flow = d.flow AND r.task = d.task
       LEFT JOIN (SELECT DISTINCT flow, task FROM odd) o ON o.flow = d.flow AND o.task = d.task""",
)
def _(e):
    sets = [(e.reads, e.declared_reads, "dataset"), (e.volatile, e.declared_volatile, "column_name")]
    return C.same_declaration(e.recorded, e.declared, sets)


@query(
    "c8_volatile_redeclared",
    """WITH a AS (SELECT flow, task, dataset, column_name FROM {volatile}), b AS (SELECT flow, task, dataset, column_name FROM {declared_volatile}),
            x AS ((SELECT * FROM a EXCEPT SELECT * FROM b) UNION (SELECT * FROM b EXCEPT SELECT * FROM a))
       SELECT DISTINCT x.flow, x.task FROM x WHERE EXISTS (SELECT 1 FROM a WHERE a.flow = x.flow AND a.task = x.task)
          OR EXISTS (SELECT 1 FROM {fps} f WHERE f.flow = x.flow AND f.task = x.task)""",
)
def _(e):
    return C.volatile_redeclared(e.volatile, e.declared_volatile, e.fps)


@query(
    "c9_volatile_conflict",
    """WITH a AS (SELECT flow, dataset, task, string_agg(column_name, ',' ORDER BY column_name) AS columns FROM {volatile} GROUP BY ALL),
            b AS (SELECT flow, dataset, task, string_agg(column_name, ',' ORDER BY column_name) AS columns FROM {declared_volatile} GROUP BY ALL)
       SELECT flow, task, dataset, other, columns, other_columns FROM (
         SELECT b.flow, b.task, b.dataset, a.task AS other, b.columns, a.columns AS other_columns,
                row_number() OVER (PARTITION BY b.flow, b.task ORDER BY b.dataset, a.task) AS rn
         FROM b JOIN a ON a.flow = b.flow AND a.dataset = b.dataset WHERE a.task <> b.task AND a.columns <> b.columns) WHERE rn = 1""",
)
def _(e):
    return C.volatile_conflict(e.declared_volatile, e.volatile)


@query(
    "c10_valid_names",
    """WITH n AS (SELECT p_partkey, replace(p_name, ' ', CASE WHEN p_size > 25 THEN '_' WHEN p_size > 10 THEN '.' ELSE ' ' END)
                   || CASE WHEN p_retailprice > 1800 THEN '.' || p_brand ELSE '' END AS name FROM part)
       SELECT p_partkey, name, CASE WHEN regexp_matches(name, '^[a-z0-9][a-z0-9_]*([.][a-z0-9][a-z0-9_]*)?$') THEN 1 ELSE 0 END AS valid FROM n""",
)
def _(e):
    glue = F.when(F.col("p_size") > 25, "_").when(F.col("p_size") > 10, ".").otherwise(" ")
    tail = F.when(F.col("p_retailprice") > 1800, F.concat(F.lit("."), "p_brand")).otherwise("")
    name = F.concat(F.replace("p_name", F.lit(" "), glue), tail)
    return e.part.select("p_partkey", name.alias("name")).withColumn(
        "valid", C.valid_name(F.col("name")).cast("int")
    )


@query(
    "c11_registration_merge",
    """SELECT coalesce(r.flow, d.flow) AS flow, coalesce(r.task, d.task) AS task, coalesce(r.status, 'registered') AS status,
              coalesce(r.client, d.client) AS client, CASE WHEN d.task IS NOT NULL THEN d.title ELSE r.title END AS title
       FROM {recorded} r FULL JOIN {declared} d ON r.flow = d.flow AND r.task = d.task""",
)
def _(e):
    return C.merge_registration(e.recorded, e.declared)


@query(
    "c12_anything_redone",
    """SELECT p.flow, max(CASE WHEN ps <> cs OR pc <> cc THEN 1 ELSE 0 END) AS redone
       FROM {prev} p JOIN {cur} c ON c.flow = p.flow AND c.task = p.task AND c.dataset = p.dataset GROUP BY 1""",
    **COMPARED,
)
def _(e):
    return C.anything_redone(e.fps)


SEEN = {
    **COMPARED,
    "rec": """
        SELECT flow, dataset, task AS writer, cs, cc, ps, pc, os, oc, coalesce(os, cs) AS ss, coalesce(oc, cc) AS sc
        FROM {cur} FULL JOIN {obsv} USING (flow, task, dataset) LEFT JOIN {prev} USING (flow, task, dataset)""",
    "classified": """
        SELECT o.flow, o.task, o.dataset, o.schema_fp, o.content_fp, r.writer, r.ss, r.sc,
               CASE WHEN o.schema_fp = ss AND o.content_fp = sc THEN 'current'
                    WHEN os IS NOT NULL AND o.schema_fp = cs AND o.content_fp = cc THEN 'superseded-notice'
                    WHEN o.schema_fp = ps AND o.content_fp = pc THEN 'superseded-report' ELSE 'unknown' END AS verdict
        FROM {observations} o JOIN {rec} r ON r.flow = o.flow AND r.dataset = o.dataset""",
    "decided": """
        SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY flow, task, dataset
            ORDER BY CASE verdict WHEN 'current' THEN 0 WHEN 'unknown' THEN 2 ELSE 1 END, writer) AS rn FROM {classified}) WHERE rn = 1""",
}


@query("o1_classify_observations", "SELECT flow, task, dataset, writer, verdict FROM {classified}", **SEEN)
def _(e):
    return C.classify(e.observations, e.fps).select("flow", "task", "dataset", "writer", "verdict")


@query("o2_resolve_verdicts", "SELECT flow, task, dataset, writer, verdict FROM {decided}", **SEEN)
def _(e):
    return C.resolve(e.observations, e.fps).select("flow", "task", "dataset", "writer", "verdict")


@query(
    "o3_inputs_without_record",
    """SELECT o.flow, o.task, o.dataset, coalesce(d.verdict, CASE WHEN w.dataset IS NOT NULL THEN 'writer-unfinished' ELSE 'nothing-writes-it' END) AS verdict, d.writer
       FROM {observations} o LEFT JOIN {decided} d ON d.flow = o.flow AND d.task = o.task AND d.dataset = o.dataset
       LEFT JOIN (SELECT DISTINCT flow, dataset FROM {writes}) w ON w.flow = o.flow AND w.dataset = o.dataset
       WHERE NOT EXISTS (SELECT 1 FROM {report_outputs} p WHERE p.flow = o.flow AND p.task = o.task AND p.dataset = o.dataset)""",
    **SEEN,
)
def _(e):
    return C.observation_verdicts(e.observations, e.fps, e.writes, e.report_outputs)


@query(
    "o4_unreported_changes",
    f"SELECT flow, task, dataset, schema_fp, content_fp, {kind('ss', 'sc', 'schema_fp', 'content_fp')} AS kind FROM {{decided}} WHERE verdict = 'unknown'",
    **SEEN,
)
def _(e):
    return C.unreported_changes(e.observations, e.fps)


@query(
    "o5_superseded_marks",
    f"""SELECT flow, task, dataset AS caused_by, CASE WHEN verdict = 'superseded-report' THEN writer END AS caused_by_task, 1 AS hops,
           {kind("schema_fp", "content_fp", "ss", "sc")} AS kind FROM {{decided}} WHERE starts_with(verdict, 'superseded')""",
    **SEEN,
)
def _(e):
    return C.superseded_marks(e.observations, e.fps)


OUTSIDE = {
    **SEEN,
    "out_all": """
        SELECT o.flow, o.dataset, o.schema_fp, o.content_fp, r.writer, r.ss, r.sc,
               CASE WHEN r.writer IS NULL THEN 'no-record' WHEN o.schema_fp = ss AND o.content_fp = sc THEN 'current'
                    WHEN os IS NOT NULL AND o.schema_fp = cs AND o.content_fp = cc THEN 'superseded'
                    WHEN o.schema_fp = ps AND o.content_fp = pc THEN 'superseded' ELSE 'changed' END AS verdict
        FROM {outside} o LEFT JOIN {rec} r ON r.flow = o.flow AND r.dataset = o.dataset""",
    "out_decided": f"""
        SELECT flow, dataset, verdict, CASE WHEN verdict = 'changed' THEN {kind("ss", "sc", "schema_fp", "content_fp")} END AS kind FROM (
          SELECT *, row_number() OVER (PARTITION BY flow, dataset ORDER BY CASE verdict WHEN 'current' THEN 0 WHEN 'changed' THEN 2 ELSE 1 END, writer) AS rn
          FROM {{out_all}}) WHERE rn = 1""",
}


@query("o6_outside_verdicts", "SELECT * FROM {out_decided}", **OUTSIDE)
def _(e):
    return C.outside_verdicts(e.outside, e.fps)


@query(
    "o6_outside_cascade",
    "SELECT * FROM {walked}",
    **{**OPEN, **OUTSIDE, "origins": "SELECT DISTINCT flow, dataset AS origin FROM {out_decided} WHERE verdict = 'changed'"},
)
def _(e):
    moved = C.outside_verdicts(e.outside, e.fps).filter("verdict = 'changed'")
    return S.affected_by(e.tasks, e.reads, e.writes, moved)


@query(
    "o7_record_observations",
    """WITH n AS (SELECT flow, dataset, min(schema_fp) AS s, min(content_fp) AS c FROM {decided} WHERE verdict = 'unknown' GROUP BY 1, 2),
            w AS (SELECT r.flow, r.writer AS task, r.dataset, n.s, n.c FROM n JOIN {rec} r ON r.flow = n.flow AND r.dataset = n.dataset)
       SELECT flow, task, dataset, 'observed' AS slot, s AS schema_fp, c AS content_fp FROM w
       UNION ALL SELECT f.flow, f.task, f.dataset, f.slot, f.schema_fp, f.content_fp FROM {fps} f
       WHERE f.slot <> 'observed' OR NOT EXISTS (SELECT 1 FROM w WHERE w.flow = f.flow AND w.task = f.task AND w.dataset = f.dataset)""",
    **SEEN,
)
def _(e):
    noticed = C.unreported_changes(e.observations, e.fps).groupBy("flow", "dataset").agg(
        F.min("schema_fp").alias("schema_fp"), F.min("content_fp").alias("content_fp")
    )
    return C.record_observations(e.fps, noticed)


@query(
    "o8_fold_completion",
    """WITH x AS (SELECT c.*, k.cs, k.cc FROM {compared} c LEFT JOIN {cur} k ON k.flow = c.flow AND k.task = c.task AND k.dataset = c.dataset),
         n AS (SELECT flow, task, dataset, 'current' AS slot, schema_fp, content_fp FROM x
               UNION ALL SELECT flow, task, dataset, 'previous', cs, cc FROM x WHERE kind IS NOT NULL)
       SELECT * FROM n UNION ALL SELECT flow, task, dataset, slot, schema_fp, content_fp FROM {fps} f
       WHERE NOT EXISTS (SELECT 1 FROM n WHERE n.flow = f.flow AND n.task = f.task AND n.dataset = f.dataset AND n.slot = f.slot)
         AND NOT (slot = 'observed' AND EXISTS (SELECT 1 FROM x WHERE x.flow = f.flow AND x.task = f.task AND x.dataset = f.dataset))""",
    **COMPARED,
)
def _(e):
    return C.fold_completion(e.fps, e.report_outputs)


MERGED = {
    **OPEN,
    "merged": """
        SELECT flow, task, caused_by, caused_by_task, max_by(hops, fresh) AS hops, max_by(kind, fresh) AS kind, max(fresh) AS fresh FROM (
          SELECT flow, task, caused_by, caused_by_task, hops, kind, 0 AS fresh FROM {causes}
          UNION ALL SELECT flow, task, caused_by, caused_by_task, hops, kind, 1 FROM {found_causes})
        GROUP BY flow, task, caused_by, caused_by_task""",
}


def cascade(e):
    return S.cause_rows(S.affected_by(e.tasks, e.reads, e.writes, e.changes), e.changes, e.writes)


@query("o9_merged_causes", "SELECT * FROM {merged}", **MERGED)
def _(e):
    return S.merge_causes(e.causes, cascade(e))


@query(
    "o9_merged_marks",
    """WITH m AS (SELECT flow, task, hops, caused_by, caused_by_task, kind, row_number() OVER (PARTITION BY flow, task ORDER BY hops, caused_by, caused_by_task NULLS FIRST) AS rn,
                count(*) OVER (PARTITION BY flow, task) AS n FROM {merged})
       SELECT m.flow, m.task, coalesce(p.hops, m.hops) AS hops, coalesce(p.caused_by, m.caused_by) AS caused_by,
              CASE WHEN p.task IS NOT NULL THEN p.caused_by_task ELSE m.caused_by_task END AS caused_by_task, coalesce(p.kind, m.kind) AS kind, m.n AS n_causes
       FROM m LEFT JOIN {primary_found} p ON p.flow = m.flow AND p.task = m.task WHERE m.rn = 1""",
    **MERGED,
)
def _(e):
    incoming = materialize(cascade(e))
    return S.merged_primary(S.merge_causes(e.causes, incoming), S.primary_mark(incoming))


@query(
    "o16_bad_marks",
    """SELECT * FROM (SELECT flow, task, caused_by, hops, kind, CASE WHEN caused_by IS NULL OR caused_by = '' THEN 'no cause'
           WHEN hops IS NULL OR hops < 1 THEN 'no hop distance' WHEN kind IS NULL OR kind NOT IN ('schema', 'content', 'both') THEN 'unknown change kind' END AS problem
         FROM (SELECT flow, task, CASE WHEN kind = 'both' AND hops = 2 THEN '' ELSE caused_by END AS caused_by, hops - 1 AS hops,
                      CASE WHEN hops > 5 THEN 'moved' ELSE kind END AS kind FROM {causes})) WHERE problem IS NOT NULL""",
)
def _(e):
    damaged = e.causes.select(
        "flow",
        "task",
        F.when((F.col("kind") == "both") & (F.col("hops") == 2), "").otherwise(F.col("caused_by")).alias("caused_by"),
        (F.col("hops") - 1).alias("hops"),
        F.when(F.col("hops") > 5, "moved").otherwise(F.col("kind")).alias("kind"),
    )
    return S.bad_marks(damaged)


