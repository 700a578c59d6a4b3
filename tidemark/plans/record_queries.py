"""Fingerprints of the given tables, the ledger and its history, and the sentences."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import wording as X
from tidemark.functions.canon import canonical_numbers, row_repr
from tidemark.operators import change as C
from tidemark.operators import fingerprint as P
from tidemark.operators import ledger as L
from tidemark.operators import staleness as S
from tidemark.operators.coordinate import board_of
from tidemark.operators.timeline import timed_cascades
from tidemark.plans.erasure_queries import KERNEL, REACHED, evidence
from tidemark.operators import coverage as V
from tidemark.plans.graph_queries import OPEN
from tidemark.plans.registry import query
from tidemark.sources.estate import TABLES

#: Column kinds of the given tables, for writing each row's key in DuckDB.
COLUMNS = {
    "region": "r_regionkey:n r_name:s",
    "nation": "n_nationkey:n n_name:s n_regionkey:n",
    "customer": "c_custkey:n c_name:s c_nationkey:n c_acctbal:d c_mktsegment:s",
    "supplier": "s_suppkey:n s_name:s s_nationkey:n s_acctbal:d",
    "part": "p_partkey:n p_name:s p_brand:s p_type:s p_size:n p_retailprice:d",
    "orders": "o_orderkey:n o_custkey:n o_orderstatus:s o_totalprice:d o_orderdate:t o_orderpriority:s",
    "lineitem": "l_orderkey:n l_partkey:n l_suppkey:n l_linenumber:n l_quantity:d l_extendedprice:d l_discount:d l_tax:d l_returnflag:s l_linestatus:s l_shipdate:t",
    "events": "event_id:n ts:t user_id:n event_type:s value:d props:s",
    "documents": "doc_id:n text:s lang:s source:s n_chars:n",
    "pages": "page_id:n url:s html:s",
    "benchmark": "item_id:n text:s",
    "labels": "doc_id:n quality:n toxic:n",
    "conversations": "conv_id:n turn:n role:s text:s",
}


def digits(column: str) -> str:
    return f"CASE WHEN {column} = floor({column}) THEN CAST(CAST({column} AS BIGINT) AS VARCHAR) ELSE CAST({column} AS VARCHAR) END"


def key_sql(column: str, kind: str) -> str:
    shown = {
        "n": f"CAST({column} AS VARCHAR)",
        "d": digits(column),
        "s": f"CAST(length({column}) AS VARCHAR) || ':' || {column}",
        "t": f"CAST({column} AS VARCHAR)",
    }[kind]
    return f"coalesce({shown}, 'null')"


def columns_of(table: str, exclude: tuple[str, ...] = ()) -> list[tuple[str, str]]:
    pairs = [tuple(c.split(":")) for c in COLUMNS[table].split()]
    return [p for p in pairs if p[0] not in exclude]


def digest_sql(table: str, exclude: tuple[str, ...] = ()) -> str:
    joined = " || ',' || ".join(key_sql(*pair) for pair in columns_of(table, exclude))
    sums = " || '|' || ".join(
        f"coalesce(sum(CAST('0x' || substr(h, {start + 1}, 5) AS BIGINT)), 0)" for start in range(0, 64, 5)
    )
    names = ",".join(f"'{c}'" for c, _ in columns_of(table))
    return f"""SELECT '{table}' AS dataset, sha256(array_to_string(list_sort([{names}]), chr(31))) AS schema_fp,
        sha256(count(*) || '|' || {sums}) AS content_fp, count(*) AS row_count FROM (SELECT sha256({joined}) AS h FROM {table})"""


ALL_TABLES = " UNION ALL ".join(digest_sql(t) for t in COLUMNS)


@query("f9_fingerprint_all_tables", ALL_TABLES)
def _(e):
    return P.fingerprint_all({t: getattr(e, t) for t in COLUMNS})


@query("f4_content_fingerprint", digest_sql("lineitem").replace("'lineitem' AS dataset, ", ""))
def _(e):
    return P.fingerprint(e.lineitem, "lineitem").drop("dataset")


@query("f4_content_fingerprint_vectors")
def _(e):
    return P.fingerprint(e.embeddings, "embeddings")


@query("f6_volatile_columns_excluded", digest_sql("orders", ("o_orderdate", "o_totalprice")))
def _(e):
    return P.fingerprint(e.orders, "orders", ("o_orderdate", "o_totalprice"))


@query(
    "f3_schema_fingerprints",
    "SELECT dataset, sha256(array_to_string(list_sort(list(column_name)), chr(31))) AS schema_fp FROM {shape_columns} GROUP BY 1",
)
def _(e):
    # One list per table, as long as the table is wide.
    shapes = e.shape_columns.groupBy("dataset").agg(F.collect_list("column_name").alias("columns"))
    return shapes.select("dataset", P.schema_fp(F.col("columns")).alias("schema_fp"))


@query(
    "f1_canonical_numbers",
    f"SELECT l_orderkey, l_linenumber, {digits('l_quantity')} AS l_quantity, {digits('l_extendedprice')} AS l_extendedprice, {digits('l_discount')} AS l_discount, {digits('l_tax')} AS l_tax FROM lineitem",
)
def _(e):
    return canonical_numbers(e.lineitem.select("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax"))


@query(
    "f2_row_representation",
    f"""SELECT doc_id, sha256('[' || doc_id || ',' || CAST(to_json(text) AS VARCHAR) || ',' || CAST(to_json(lang) AS VARCHAR) || ','
          || CAST(to_json(source) AS VARCHAR) || ',' || n_chars || ']') AS row_digest FROM documents""",
)
def _(e):
    d = e.documents
    return d.select("doc_id", F.sha2(row_repr(d, ["doc_id", "text", "lang", "source", "n_chars"]), 256).alias("row_digest"))


@query(
    "f7_volatile_by_dataset",
    """WITH l AS (SELECT flow, dataset, task, string_agg(column_name, ',' ORDER BY column_name) AS c FROM {volatile} GROUP BY ALL)
       SELECT flow, dataset, min(c) AS columns, CASE WHEN min(c) <> max(c) THEN 1 ELSE 0 END AS conflict, count(*) AS declared_by FROM l GROUP BY 1, 2""",
)
def _(e):
    return P.volatile_by_dataset(e.volatile)


@query("f8_table_shape", "SELECT count(*) AS row_count, 'o_orderkey,o_custkey,o_orderstatus,o_totalprice,o_orderdate,o_orderpriority' AS columns FROM orders")
def _(e):
    return P.table_shape(e.orders)


#: Recorded digests: one table was renamed since, one lost rows, the rest stand.
RECORDED_SQL = f"""SELECT dataset, CASE dataset WHEN 'part' THEN 'different' WHEN 'nation' THEN 'different' ELSE 'reproduced' END AS outcome FROM ({ALL_TABLES})"""


@query("b11_reproduced_fingerprints", RECORDED_SQL)
def _(e):
    now = {t: getattr(e, t) for t in COLUMNS}
    then = {**now, "part": e.part.withColumnRenamed("p_name", "p_title"), "nation": e.nation.filter("n_regionkey <> 1")}
    return P.reproduce(P.fingerprint_all(then), P.fingerprint_all(now))


assert set(COLUMNS) | {"embeddings"} == set(TABLES)


# -- ledger ------------------------------------------------------------------------------------

NEW_ROWS = "SELECT 'attestation' AS kind, 'k:' || CAST(floor(o_orderkey / 3) AS BIGINT) AS ledger_key, o_orderdate AS at, o_orderkey FROM {orders}"


@query(
    "s7_ledger_append",
    """SELECT n.kind, n.ledger_key, n.o_orderkey, coalesce(h.head, 0) + row_number() OVER (PARTITION BY n.kind, n.ledger_key ORDER BY n.at, n.o_orderkey) AS seq
       FROM {new_rows} n LEFT JOIN (SELECT kind, ledger_key, max(seq) AS head FROM {ledger} GROUP BY 1, 2) h ON h.kind = n.kind AND h.ledger_key = n.ledger_key""",
    new_rows=NEW_ROWS,
)
def _(e):
    fresh = e.orders.selectExpr("'attestation' AS kind", "'k:' || CAST(floor(o_orderkey / 3) AS BIGINT) AS ledger_key", "o_orderdate AS at", "o_orderkey")
    return L.append_numbers(L.heads(e.ledger), fresh, ["at", "o_orderkey"]).select("kind", "ledger_key", "o_orderkey", "seq")


@query(
    "s8_ledger_prefix",
    """SELECT kind, ledger_key, seq, body FROM (SELECT *, row_number() OVER (PARTITION BY kind, ledger_key ORDER BY seq) AS rn FROM {ledger}) WHERE seq = rn""",
)
def _(e):
    return L.read_prefix(e.ledger).select("kind", "ledger_key", "seq", "body")


HISTORY = {
    "hist": """SELECT h.flow, h.seq, h.at, CASE WHEN json_valid(body) THEN json_extract_string(body, '$.event') END AS event,
        CASE WHEN json_valid(body) THEN CAST(json_extract_string(body, '$.elapsedMs') AS BIGINT) END AS elapsed_ms
        FROM (SELECT *, row_number() OVER (PARTITION BY flow ORDER BY seq DESC) AS nth FROM {change_records}) h WHERE nth <= 200""",
}


@query("s9_change_history", "SELECT * FROM {hist}", **HISTORY)
def _(e):
    return L.history(e.change_records)


DECISIONS = {
    "dec_affected": "SELECT flow, caused_by AS decision, task, hops, caused_by FROM {causes}",
    "dec_restored": "SELECT DISTINCT flow, 'd:' || d AS decision, 't:' || k AS task FROM {line_reads} WHERE returnflag = 'A' AND line > 3",
}


def decided(e):
    affected = e.causes.select("flow", F.col("caused_by").alias("decision"), "task", "hops", "caused_by")
    restored = e.line_reads.filter("returnflag = 'A' AND line > 3").selectExpr("flow", "'d:' || d AS decision", "'t:' || k AS task").distinct()
    return affected, restored


@query(
    "l1_change_records",
    """SELECT flow, decision, CAST(sum(a) AS BIGINT) AS affected, CAST(sum(r) AS BIGINT) AS restored, CASE WHEN sum(a) > 0 THEN 'marked' ELSE 'cleared' END AS event FROM (
         SELECT flow, decision, 1 AS a, 0 AS r FROM {dec_affected} UNION ALL SELECT flow, decision, 0, 1 FROM {dec_restored}) GROUP BY 1, 2""",
    **DECISIONS,
)
def _(e):
    return L.change_records(*decided(e))


@query(
    "l2_incidents",
    """SELECT flow, decision, min_by(caused_by, (hops, task)) AS dataset, count(*) AS flagged,
              count(*) || ' finished ' || CASE WHEN count(*) = 1 THEN 'task is' ELSE 'tasks are' END || ' out of date after ' || min_by(caused_by, (hops, task)) || ' changed' AS title,
              string_agg(task || ' (' || hops || CASE WHEN hops = 1 THEN ' hop)' ELSE ' hops)' END, chr(10) ORDER BY hops, task) FILTER (rn <= 20)
                || CASE WHEN count(*) > 20 THEN chr(10) || '… and ' || (count(*) - 20) || ' more' ELSE '' END AS body
       FROM (SELECT *, row_number() OVER (PARTITION BY flow, decision ORDER BY hops, task) AS rn FROM {dec_affected}) GROUP BY 1, 2""",
    **DECISIONS,
)
def _(e):
    return L.raise_incidents(decided(e)[0])


INCIDENTS = {
    "incident_tasks": "SELECT flow || '/' || 'd:' || d AS incident, flow, 'd:' || d AS dataset, 't:' || k AS task FROM {line_reads} GROUP BY flow, d, k",
}


@query(
    "l3_closable_incidents",
    """SELECT DISTINCT incident, flow, dataset FROM {incident_tasks} i WHERE incident NOT IN (
         SELECT j.incident FROM {incident_tasks} j JOIN {causes} c ON c.flow = j.flow AND c.task = j.task AND c.caused_by = j.dataset)""",
    **INCIDENTS,
)
def _(e):
    named = e.line_reads.selectExpr("flow || '/' || 'd:' || d AS incident", "flow", "'d:' || d AS dataset", "'t:' || k AS task").distinct()
    return L.closable(named, e.causes)


FOLDED = {
    **OPEN,
    "finishing": "SELECT DISTINCT flow, task FROM {report_outputs} WHERE report IN (SELECT report FROM {reports} WHERE event_type = 'click')",
    "merged": """SELECT c.flow, c.task, c.caused_by, c.caused_by_task, max_by(c.hops, c.fresh) AS hops, max_by(c.kind, c.fresh) AS kind FROM (
          SELECT flow, task, caused_by, caused_by_task, hops, kind, 0 AS fresh FROM {causes} SEMI JOIN {found_causes} USING (flow, task)
          UNION ALL SELECT flow, task, caused_by, caused_by_task, hops, kind, 1 FROM {found_causes}) c GROUP BY 1, 2, 3, 4""",
    "superseded": "SELECT c.* EXCLUDE (since) FROM {causes} c SEMI JOIN {finishing} f ON f.flow = c.flow AND f.task = c.task WHERE c.hops = 1",
    "restored": "SELECT DISTINCT flow, task FROM {declared} WHERE client IS NULL AND title = ''",
}


@query(
    "l4_marks_after_decision",
    """SELECT flow, task, caused_by, caused_by_task, hops, kind FROM (
         SELECT * FROM (SELECT flow, task, caused_by, caused_by_task, hops, kind FROM {causes} ANTI JOIN {merged} USING (flow, task)
           UNION ALL SELECT flow, task, caused_by, caused_by_task, hops, kind FROM {merged}) ANTI JOIN {finishing} USING (flow, task)
         UNION ALL SELECT flow, task, caused_by, caused_by_task, hops, kind FROM {superseded}) ANTI JOIN {restored} USING (flow, task)""",
    **FOLDED,
)
def _(e):
    found = S.cause_rows(S.affected_by(e.tasks, e.reads, e.writes, e.changes), e.changes, e.writes)
    existing = e.causes.join(found.select("flow", "task"), ["flow", "task"], "left_semi")
    clicks = e.reports.filter("event_type = 'click'").select("report")
    finishing = e.report_outputs.join(clicks, "report", "left_semi").select("flow", "task").distinct()
    superseded = e.causes.filter("hops = 1").join(finishing, ["flow", "task"], "left_semi")
    restored = e.declared.filter("client IS NULL AND title = ''").select("flow", "task").distinct()
    return L.causes_after(e.causes, S.merge_causes(existing, found), finishing, superseded, restored)


@query("l5_repaired_tables", "SELECT DISTINCT flow, caused_by FROM {causes} SEMI JOIN {declared} USING (flow, task)")
def _(e):
    return L.repaired_tables(e.causes, e.declared)


@query(
    "l6_candidate_incidents",
    """SELECT DISTINCT flow, 'i:' || CAST(floor(seq / 2) AS BIGINT) AS incident FROM {change_records}
       WHERE (flow, 'i:' || CAST(floor(seq / 2) AS BIGINT)) IN (SELECT (o_orderpriority, 'i:' || CAST(floor(o_orderkey / 2) AS BIGINT)) FROM orders WHERE o_orderstatus <> 'F')""",
)
def _(e):
    named = F.concat(F.lit("i:"), F.floor(F.col("seq") / 2).cast("string"))
    active = e.orders.filter("o_orderstatus <> 'F'").selectExpr("o_orderpriority AS flow", "'i:' || CAST(floor(o_orderkey / 2) AS BIGINT) AS incident").distinct()
    return L.candidate_incidents(e.change_records.withColumn("incident", named), active)


@query(
    "l7_history_rows",
    """SELECT flow, seq, CASE WHEN affected IS NULL THEN 'a decision was recorded here that cannot be read' WHEN affected + restored = 0 THEN 'a decision was recorded that changed nothing'
          ELSE concat_ws(', ', CASE WHEN affected > 0 THEN affected || CASE WHEN affected = 1 THEN ' task' ELSE ' tasks' END || ' went out of date' END,
                         CASE WHEN restored > 0 THEN restored || CASE WHEN restored = 1 THEN ' flag' ELSE ' flags' END || ' came off' END) END AS headline
       FROM (SELECT o_orderpriority AS flow, o_orderkey AS seq, CASE WHEN o_totalprice > 5000 THEN CAST(floor(o_totalprice / 100000) AS BIGINT) END AS affected,
                    CASE WHEN o_totalprice > 5000 THEN CASE WHEN o_orderstatus = 'F' THEN 1 WHEN o_orderstatus = 'O' THEN 2 ELSE 0 END END AS restored FROM orders)""",
)
def _(e):
    told = e.orders.selectExpr(
        "o_orderpriority AS flow",
        "o_orderkey AS seq",
        "CASE WHEN o_totalprice > 5000 THEN CAST(floor(o_totalprice / 100000) AS BIGINT) END AS affected",
        "CASE WHEN o_totalprice > 5000 THEN CASE WHEN o_orderstatus = 'F' THEN 1 WHEN o_orderstatus = 'O' THEN 2 ELSE 0 END END AS restored",
    )
    return L.history_rows(told)


@query(
    "t8_trace_passes",
    "SELECT flow, seq, phase, CAST(sum(CASE WHEN phase = 'read' THEN 1 ELSE 0 END) OVER (PARTITION BY flow ORDER BY seq) AS BIGINT) AS pass_no FROM {trace}",
)
def _(e):
    return L.passes(e.trace.select("flow", "seq", "phase"))


@query("t9_newest_events", "SELECT flow, seq, phase FROM (SELECT *, row_number() OVER (PARTITION BY flow ORDER BY seq DESC) AS nth FROM {trace}) WHERE nth <= 20")
def _(e):
    return L.newest_events(e.trace, 20).select("flow", "seq", "phase")


# -- names and sentences -----------------------------------------------------------------------


@query(
    "x1_x5_names",
    """SELECT p_partkey, u AS urn, split_part(split_part(u, ',', 2), '.', -1) AS short, replace(split_part(split_part(u, ',', 2), '.', -1), '_', ' ') AS label,
              t AS job, regexp_replace(split_part(t, ',', -1), '\\)+$', '') AS job_name,
              CASE WHEN p_size > 20 THEN p_name ELSE replace(n, '_', ' ') END AS task_label, p_size || CASE WHEN p_size = 1 THEN ' hop' ELSE ' hops' END AS hops FROM (
         SELECT *, replace(p_name, ' ', '_') AS n, 'urn:li:dataset:(urn:li:dataPlatform:lake,' || CASE WHEN p_size > 25 THEN '' ELSE 'warehouse.' END
                || CASE WHEN p_size > 25 THEN lower(p_type) || '.' ELSE '' END || replace(p_name, ' ', '_') || ',PROD)' AS u,
                'urn:li:dataJob:(urn:li:dataFlow:(spark,' || p_brand || ',PROD),' || replace(p_name, ' ', '_') || ')' AS t FROM part)""",
)
def _(e):
    name = F.replace("p_name", F.lit(" "), F.lit("_"))
    spaced = F.when(F.col("p_size") > 25, F.concat(F.lower("p_type"), F.lit("."), name)).otherwise(name)
    title = F.when(F.col("p_size") > 20, F.col("p_name")).otherwise("")
    made = e.part.select("p_partkey", "p_size", name.alias("n"), title.alias("title"), X.dataset_urn(spaced).alias("urn"), X.task_urn(F.col("p_brand"), name).alias("job"))
    return made.select(
        "p_partkey",
        "urn",
        X.short_name(F.col("urn")).alias("short"),
        X.table_label(F.col("urn")).alias("label"),
        "job",
        X.task_name(F.col("job")).alias("job_name"),
        X.task_label(F.col("title"), F.col("n")).alias("task_label"),
        X.hop_label(F.col("p_size")).alias("hops"),
    )


@query(
    "x6_reasons",
    """SELECT flow, task, caused_by, CASE WHEN hops > 1 THEN 'built on work from ' || coalesce(via, 'an upstream task') || ', which is itself out of date because ' || t || ' changed'
          ELSE 'read ' || t || ', and ' || CASE kind WHEN 'schema' THEN 'its columns changed' WHEN 'content' THEN 'its rows changed' ELSE 'its columns and rows changed' END || ' after this finished'
            || CASE WHEN kind = 'schema' THEN ', leaving batch and loaded_at aside, which are registered as different in every run' ELSE '' END
            || CASE WHEN unreported = 0 THEN '' WHEN via IS NOT NULL THEN '. Nothing reported that change; it was noticed when ' || via || ' read the table'
                    ELSE '. Nothing reported that change; an outside observer reported the table''s contents' END END AS reason
       FROM (SELECT *, replace(caused_by, '_', ' ') AS t, caused_by_task AS via, CASE WHEN kind = 'both' THEN 1 ELSE 0 END AS unreported FROM {causes})""",
)
def _(e):
    c = e.causes
    excluded = F.when(F.col("kind") == "schema", F.array(F.lit("loaded_at"), F.lit("batch")))
    said = X.reason(
        F.col("hops"), F.col("caused_by"), F.col("kind"), (F.col("kind") == "both").cast("int"), F.col("caused_by_task"), F.col("caused_by_task"), excluded
    )
    return c.select("flow", "task", "caused_by", said.alias("reason"))


@query(
    "x7_restored_reasons",
    """SELECT flow, task, 'task ' || substr(task, 3) || ' redid ' || string_agg(dataset, ', ' ORDER BY dataset) || CASE WHEN count(*) = 1 THEN ' and it came out identical' ELSE ' and they came out identical' END
              || ', so everything this was built on still stands' AS reason FROM {writes} GROUP BY flow, task""",
)
def _(e):
    per = e.writes.groupBy("flow", "task").agg(F.collect_set("dataset").alias("tables"))
    label = X.task_label(F.lit(""), F.concat(F.lit("task_"), F.regexp_replace("task", "^t:", "")))
    return per.select("flow", "task", X.restored_reason(label, F.col("tables")).alias("reason"))


@query(
    "x8_durations",
    """SELECT o_orderkey, CASE WHEN ms < 0 THEN '··' WHEN ms < 1000 THEN ms || ' ms' WHEN ms < 60000 THEN CAST((ms + 50) // 100 // 10 AS VARCHAR) || '.' || ((ms + 50) // 100 % 10) || ' s'
              ELSE ((ms + 500) // 1000 // 60) || ' m ' || lpad(CAST((ms + 500) // 1000 % 60 AS VARCHAR), 2, '0') || ' s' END AS took
       FROM (SELECT o_orderkey, CAST(floor(o_totalprice * CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0.1 END) AS BIGINT) - 500 AS ms FROM orders)""",
)
def _(e):
    scale = F.when(F.col("o_orderstatus") == "F", F.lit(1)).otherwise(F.lit(0.1))
    ms = F.floor(F.col("o_totalprice") * scale).cast("long") - 500
    return e.orders.select("o_orderkey", X.duration(ms).alias("took"))


#: The sentence of a residue row r, with t the words for its asset and input those for its input.
RESIDUE_SQL = """CASE r.kind
    WHEN 'no-attestation' THEN 'nobody has attested anything about ' || t
    WHEN 'not-total' THEN 'the run that wrote it was a ' || r.detail || ', which leaves earlier rows in place'
    WHEN 'partitions-uncovered' THEN split_part(r.detail, '/', 1) || ' of ' || split_part(r.detail, '/', 2) || ' partitions are covered'
    WHEN 'not-sole-producer' THEN 'more than one run contributed to this version of ' || t
    WHEN 'no-recorded-lineage' THEN 'no upstream lineage is recorded for ' || t || ', so a rebuild has nothing to be checked against'
    WHEN 'closure-mismatch' THEN 'the rebuild did not declare ' || r.input || ', which is recorded as feeding it'
    WHEN 'unattested-input' THEN 'it was built from ' || r.input || ' at version ' || split_part(r.detail, '@', 2) || ', which is unattested'
    WHEN 'predicate-gap' THEN 'nobody searched for ' || r.detail
    WHEN 'predicate-split' THEN 'no single attestation searched for every identifier; ' || r.detail || ' was searched on its own'
    WHEN 'unverified-signature' THEN 'a record from ' || r.detail || ' could not be verified'
    WHEN 'attested-other-version' THEN 'it was attested at version ' || r.detail || ' and has been written since'
    END"""


def shown(urn: str) -> str:
    """The words for a dataset's name."""
    return f"replace(string_split(coalesce(string_split({urn}, ',')[2], {urn}), '.')[-1], '_', ' ')"


@query("x9_residue_sentences", f"SELECT request, asset, version, kind, {RESIDUE_SQL} AS sentence FROM (SELECT *, {shown('asset')} AS t, {shown("split_part(detail, '@', 1)")} AS input FROM {{residue}}) r", **KERNEL)
def _(e):
    reasons = V.residue(V.derive(evidence(e)))
    said = X.residue_sentence(F.col("kind"), F.col("detail"), X.table_label(F.col("asset")))
    return reasons.select("request", "asset", "version", "kind", said.alias("sentence"))


@query("x9_gap_sentences", "SELECT request, asset, version, 'nobody searched for ' || string_agg(detail, ' and ' ORDER BY detail) AS sentence FROM {residue} WHERE kind = 'predicate-gap' GROUP BY ALL", **KERNEL)
def _(e):
    """One sentence a version for all identifiers nobody searched for; a request's identifiers bound the list."""
    gaps = V.residue(V.derive(evidence(e)), "predicate-gap")
    said = X.gap_sentence(F.array_sort(F.collect_list("detail")))
    return gaps.groupBy("request", "asset", "version").agg(said.alias("sentence"))


@query(
    "e16_explanations",
    """WITH named AS (SELECT *, """ + shown("asset") + """ AS t FROM {states}),
            short AS (SELECT *, """ + shown("split_part(detail, '@', 1)") + """ AS input FROM {residue}),
            first AS (SELECT request, asset, version, min({{'rank': rank, 'detail': coalesce(detail, ''), 'kind': kind, 'input': coalesce(input, '')}}) AS r FROM short GROUP BY 1, 2, 3)
       SELECT n.request, n.asset, n.version, n.state, CASE n.state WHEN 'ATTESTED' THEN t || ' at version ' || n.version || ' is attested'
              WHEN 'CONTRADICTED' THEN t || ' is contradicted: the subject was found in version ' || found_in
              ELSE t || ' at version ' || n.version || ' is unattested: ' || """ + RESIDUE_SQL + """ END AS explanation
       FROM named n LEFT JOIN first f ON f.request = n.request AND f.asset = n.asset AND f.version = n.version""",
    **KERNEL,
)
def _(e):
    """Every reached asset in one sentence; of an unattested one, its most fundamental reason."""
    d = V.derive(evidence(e))
    key = ["request", "asset", "version"]
    first = V.residue(d).groupBy(*key).agg(F.min(F.struct("rank", F.coalesce("detail", F.lit("")).alias("detail"), "kind")).alias("r"))
    table = X.table_label(F.col("asset"))
    why = X.residue_sentence(F.col("r.kind"), F.col("r.detail"), table)
    said = X.explanation(table, F.col("version"), F.col("state"), why, F.col("found_in"))
    return V.states(d).join(first, key, "left").select(*key, "state", said.alias("explanation"))


@query(
    "x11_assurance_lines",
    """WITH c AS (
         SELECT q.request, coalesce(q.hops, 3) AS h, (SELECT count(*) FROM {reached} r WHERE r.request = q.request) AS n,
                1 + (SELECT count(*) FROM {attestations} a SEMI JOIN {reached} r ON r.request = a.request AND r.asset = a.asset WHERE a.request = q.request) AS k
         FROM {requests} q)
       SELECT request, 'Walked ' || h || CASE h WHEN 1 THEN ' hop' ELSE ' hops' END || ' downstream, reached ' || n || CASE n WHEN 1 THEN ' asset' ELSE ' assets' END
              || ', built from ' || k || ' ledger ' || CASE k WHEN 1 THEN 'record' ELSE 'records' END AS line FROM c""",
    **REACHED,
)
def _(e):
    said = X.assurance_line(F.col("hops_walked"), F.col("assets_reached"), F.col("evidence_records"))
    return V.assurance(evidence(e, "attestations"), e.requests).select("request", said.alias("line"))


@query(
    "x11_lead_lines",
    """SELECT request, attested || ' of ' || total || CASE WHEN total = 1 THEN ' asset' ELSE ' assets' END || ' covered, ' || unproven || ' unattested'
              || CASE WHEN contradicted > 0 THEN ', ' || contradicted || ' reported still present' ELSE '' END AS line
       FROM (SELECT request, count(*) AS total, count(*) FILTER (state = 'ATTESTED') AS attested, count(*) FILTER (state = 'UNPROVEN') AS unproven,
                    count(*) FILTER (state = 'CONTRADICTED') AS contradicted FROM {states} GROUP BY 1)""",
    **KERNEL,
)
def _(e):
    counts = V.summary(V.states(V.derive(evidence(e))))
    line = X.coverage_line(F.col("total"), F.col("attested"), F.col("unproven"), F.col("contradicted"))
    return counts.select("request", line.alias("line"))


@query(
    "x11_board_lines",
    """SELECT flow, stale || ' of ' || finished || ' finished ' || CASE WHEN finished = 1 THEN 'agent' ELSE 'agents' END || CASE WHEN stale = 1 THEN ' is' ELSE ' are' END
              || ' out of date, because a table ' || CASE WHEN stale = 1 THEN 'it' ELSE 'they' END || ' read changed afterwards.' AS line
       FROM (SELECT flow, count(*) FILTER (status IN ('complete', 'stale')) AS finished, count(*) FILTER (status = 'stale') AS stale FROM {tasks} GROUP BY 1)""",
)
def _(e):
    counts = e.tasks.groupBy("flow").agg(
        F.count(F.lit(1)).alias("total"), F.count_if(F.col("status").isin("complete", "stale")).alias("finished"), F.count_if(F.col("status") == "stale").alias("stale")
    )
    return counts.select("flow", X.board_line(F.col("total"), F.col("finished"), F.col("stale")).alias("line"))


@query(
    "x11_completion_lines",
    """SELECT o.report, CASE WHEN coalesce(n_changed, 0) = 0 THEN 'no outputs changed; nothing was marked stale (unreported)'
              WHEN coalesce(n_marked, 0) = 0 THEN 'nothing downstream had finished, so nothing was marked (unreported)'
              ELSE 'marked ' || n_marked || ' finished task(s) stale in unreported' END AS line
       FROM (SELECT DISTINCT report FROM {report_outputs}) o
       LEFT JOIN (SELECT report, count(*) AS n_changed FROM {moved} GROUP BY 1) c ON c.report = o.report
       LEFT JOIN (SELECT report, count(DISTINCT task) AS n_marked FROM {marked} GROUP BY 1) m ON m.report = o.report""",
    moved="""
        SELECT r.report, r.flow, r.task AS reporter, r.dataset FROM {report_outputs} r JOIN {fps} f
          ON f.flow = r.flow AND f.task = r.task AND f.dataset = r.dataset AND f.slot = 'current'
        WHERE f.schema_fp <> r.schema_fp OR f.content_fp <> r.content_fp""",
    marked="""
        WITH RECURSIVE w(report, flow, reporter, task) AS (
          SELECT DISTINCT m.report, m.flow, m.reporter, r.task FROM {moved} m JOIN {open_reads} r
            ON r.flow = m.flow AND r.dataset = m.dataset AND r.task <> m.reporter
          UNION
          SELECT w.report, w.flow, w.reporter, h.dst FROM w JOIN {hop_edges} h ON h.flow = w.flow AND h.src = w.task AND h.dst <> w.reporter)
        SELECT * FROM w""",
    **OPEN,
)
def _(e):
    """Each report as if it came first: what it changed, and whom that reaches."""
    compared = C.compare_outputs(e.report_outputs, e.fps)
    changed = compared.groupBy("report").agg(F.count_if(F.col("outcome") == "changed").alias("changed"))
    moved = compared.filter("outcome = 'changed'").select("flow", F.col("report").alias("at"), F.col("task").alias("reporter"), "dataset")
    board = board_of(e)
    none = e.reports.select("flow", "task", F.col("report").alias("at")).limit(0)
    reached = timed_cascades(board, none, moved.withColumn("at", F.col("at") + 1))
    marked = reached.groupBy((F.col("at") - 1).alias("report")).agg(F.count_distinct("task").alias("marked"))
    line = X.completion_line(F.col("changed"), F.coalesce("marked", F.lit(0)), F.lit(None).cast("long"))
    return changed.join(marked, "report", "left").select("report", line.alias("line"))
