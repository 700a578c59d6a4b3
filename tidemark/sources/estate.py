"""A board-and-evidence estate derived by formula from the TPC-H-style tables.

Each view is one SELECT over the given tables or over earlier views, in SQL both engines accept,
so the same definition feeds the Spark operators and the checks against DuckDB. Only inputs are
defined here; everything an operator computes lives with the operator.
"""

from __future__ import annotations

from string import Formatter

from pyspark.sql import DataFrame, SparkSession

from tidemark.session import materialize

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()

VIEWS: dict[str, str] = {
    # One task per order; the order's priority is the board it sits on.
    "tasks": """
        SELECT o_orderpriority AS flow, 't:' || o_orderkey AS task, 'task_' || o_orderkey AS name,
               CASE WHEN o_totalprice > 250000 THEN 'Order ' || o_orderkey ELSE '' END AS title,
               CASE WHEN o_orderstatus = 'F' THEN 'complete' WHEN o_orderstatus = 'O' THEN 'stale'
                    WHEN o_totalprice < 90000 THEN 'running'
                    WHEN o_totalprice < 180000 THEN 'registered' ELSE 'complete' END AS status,
               CASE WHEN o_totalprice < 495000 THEN o_orderdate END AS finished_at,
               o_orderdate AS started_at,
               CASE WHEN o_totalprice < 480000 THEN CAST(floor(o_totalprice) AS BIGINT) END AS run_ms,
               CASE WHEN o_totalprice < 1200 THEN 1 ELSE 0 END AS removed
        FROM {orders}""",
    # Task k writes table k; an expensive order also writes the next table, which then has two writers.
    "writes": """
        SELECT o_orderpriority AS flow, 't:' || o_orderkey AS task, 'd:' || o_orderkey AS dataset, 0 AS ord
        FROM {orders}
        UNION ALL
        SELECT o_orderpriority AS flow, 't:' || o_orderkey AS task, 'd:' || (o_orderkey + 1) AS dataset, 1 AS ord
        FROM {orders} WHERE o_totalprice > 450000""",
    # Line j of order k reads table k div (j + 1), always an older one.
    "line_reads": """
        SELECT o.o_orderpriority AS flow, l.l_orderkey AS k,
               CAST(floor(l.l_orderkey / (l.l_linenumber + 1)) AS BIGINT) AS d,
               l.l_linenumber AS line, l.l_returnflag AS returnflag, l.l_linestatus AS linestatus,
               l.l_shipdate AS shipdate
        FROM {lineitem} l JOIN {orders} o ON l.l_orderkey = o.o_orderkey
        WHERE CAST(floor(l.l_orderkey / (l.l_linenumber + 1)) AS BIGINT) < l.l_orderkey""",
    "reads": """
        SELECT DISTINCT flow, 't:' || k AS task, 'd:' || d AS dataset FROM {line_reads}""",
    # The urgent board's tables moved; elsewhere the cheaper high-priority ones did.
    "changes": """
        SELECT o_orderpriority AS flow, 'd:' || o_orderkey AS dataset,
               CASE o_orderstatus WHEN 'F' THEN 'schema' WHEN 'O' THEN 'content' ELSE 'both' END AS kind,
               CASE WHEN o_totalprice > 300000 THEN 1 ELSE 0 END AS unreported
        FROM {orders} WHERE o_orderpriority = '1-URGENT' OR o_totalprice < 120000""",
    # Standing marks: one row per recorded cause of a flagged task.
    "causes": """
        SELECT r.flow, 't:' || r.k AS task, 'd:' || r.d AS caused_by,
               CASE WHEN min(r.linestatus) = 'F' THEN 't:' || r.d END AS caused_by_task,
               min(r.line) AS hops,
               CASE max(r.returnflag) WHEN 'R' THEN 'schema' WHEN 'N' THEN 'content' ELSE 'both' END AS kind,
               max(r.shipdate) AS since
        FROM {line_reads} r JOIN {orders} o ON o.o_orderkey = r.k
        WHERE o.o_orderstatus = 'O' AND r.returnflag <> 'A' AND o.o_totalprice > 60000
        GROUP BY r.flow, r.k, r.d""",
    # Fingerprints on record, one row per slot.
    "fps": """
        SELECT w.flow, w.task, w.dataset, 'current' AS slot, 's:' || o.o_orderstatus AS schema_fp,
               'c:' || CAST(floor(o.o_totalprice) AS BIGINT) AS content_fp
        FROM {writes} w JOIN {orders} o ON w.task = 't:' || o.o_orderkey
        WHERE o.o_orderstatus <> 'P' OR o.o_totalprice > 180000
        UNION ALL
        SELECT w.flow, w.task, w.dataset, 'previous' AS slot, 's:' || o.o_orderstatus AS schema_fp,
               'p:' || o.o_custkey AS content_fp
        FROM {writes} w JOIN {orders} o ON w.task = 't:' || o.o_orderkey
        WHERE o.o_totalprice > 300000
        UNION ALL
        SELECT w.flow, w.task, w.dataset, 'observed' AS slot, 's:X' AS schema_fp,
               'o:' || o.o_custkey AS content_fp
        FROM {writes} w JOIN {orders} o ON w.task = 't:' || o.o_orderkey
        WHERE o.o_totalprice BETWEEN 280000 AND 330000""",
    # What each run's outputs looked like: rows, and one row per column in order.
    "shapes": """
        SELECT 't:' || l_orderkey AS task, 'd:' || l_orderkey AS dataset, count(*) AS row_count
        FROM {lineitem} GROUP BY l_orderkey""",
    "shape_columns": """
        SELECT 't:' || l_orderkey AS task, 'd:' || l_orderkey AS dataset, 'col_' || l_returnflag || l_linenumber AS column_name,
               min(l_linenumber) AS pos
        FROM {lineitem} GROUP BY l_orderkey, l_returnflag, l_linenumber""",
    # One completion report per event; its task is the order with that number.
    "reports": """
        SELECT e.event_id AS report, o.o_orderpriority AS flow, 't:' || e.event_id AS task, e.ts AS finished_at,
               e.event_type
        FROM {events} e JOIN {orders} o ON o.o_orderkey = e.event_id""",
    "report_outputs": """
        SELECT e.event_id AS report, o.o_orderpriority AS flow, 't:' || e.event_id AS task, 'd:' || e.event_id AS dataset,
               CASE WHEN e.event_type IN ('signup', 'purchase') THEN 's:N' ELSE 's:' || o.o_orderstatus END AS schema_fp,
               CASE WHEN e.event_type IN ('view', 'purchase') THEN 'n:' || e.user_id
                    ELSE 'c:' || CAST(floor(o.o_totalprice) AS BIGINT) END AS content_fp
        FROM {events} e JOIN {orders} o ON o.o_orderkey = e.event_id WHERE e.event_type <> 'error'
        UNION ALL
        SELECT e.event_id AS report, o.o_orderpriority AS flow, 't:' || e.event_id AS task, 'd:' || (e.event_id + 1) AS dataset,
               's:N' AS schema_fp, 'x:' || e.user_id AS content_fp
        FROM {events} e JOIN {orders} o ON o.o_orderkey = e.event_id WHERE e.value > 35""",
    # What a task saw when it read: the writer's current bytes, an older version, or neither.
    "observations": """
        SELECT r.flow, 't:' || r.k AS task, 'd:' || r.d AS dataset,
               CASE WHEN min(r.line) = 4 THEN 's:X' ELSE 's:' || min(w.o_orderstatus) END AS schema_fp,
               CASE WHEN min(r.line) < 3 THEN 'c:' || CAST(floor(min(w.o_totalprice)) AS BIGINT)
                    WHEN min(r.line) = 3 THEN 'p:' || min(w.o_custkey)
                    WHEN min(r.line) = 4 THEN 'o:' || min(w.o_custkey)
                    ELSE 'z:' || min(r.line) END AS content_fp
        FROM {line_reads} r JOIN {orders} w ON w.o_orderkey = r.d
        GROUP BY r.flow, r.k, r.d""",
    # Volatile columns a task registered for a table it writes.
    "volatile": """
        SELECT w.flow, w.task, w.dataset, 'col_' || l.l_returnflag || l.l_linenumber AS column_name
        FROM {writes} w JOIN {lineitem} l ON w.task = 't:' || l.l_orderkey
        WHERE l.l_tax > 0.06
        GROUP BY w.flow, w.task, w.dataset, l.l_returnflag, l.l_linenumber""",
    # The same registrations sent again: a few titles, inputs and volatile lists have moved.
    "declared": """
        SELECT o_orderpriority AS flow, 't:' || o_orderkey AS task,
               CASE WHEN o_totalprice > 260000 THEN 'Order ' || o_orderkey ELSE '' END AS title,
               CASE WHEN o_orderstatus = 'F' THEN 'client-new' END AS client
        FROM {orders} WHERE o_totalprice > 40000""",
    "recorded": """
        SELECT o_orderpriority AS flow, 't:' || o_orderkey AS task,
               CASE WHEN o_totalprice > 250000 THEN 'Order ' || o_orderkey ELSE '' END AS title,
               CASE WHEN o_totalprice > 300000 THEN 'client-old' END AS client,
               CASE WHEN o_orderstatus = 'F' THEN 'complete' WHEN o_orderstatus = 'O' THEN 'stale' ELSE 'running' END AS status
        FROM {orders} WHERE o_totalprice < 460000""",
    "declared_reads": """
        SELECT DISTINCT flow, 't:' || k AS task, 'd:' || d AS dataset FROM {line_reads} WHERE line < 7 OR returnflag <> 'R'""",
    "declared_volatile": """
        SELECT w.flow, w.task, w.dataset, 'col_' || l.l_returnflag || l.l_linenumber AS column_name
        FROM {writes} w JOIN {lineitem} l ON w.task = 't:' || l.l_orderkey
        WHERE l.l_tax > 0.06 AND (l.l_discount < 0.09 OR l.l_quantity < 25)
        GROUP BY w.flow, w.task, w.dataset, l.l_returnflag, l.l_linenumber""",
    "tags": """
        SELECT o_orderpriority AS flow, 't:' || o_orderkey AS task,
               CASE WHEN o_totalprice > 100000 THEN 'stale_work' ELSE 'reviewed' END AS tag
        FROM {orders} WHERE o_orderstatus <> 'F'""",
    "measured": """
        SELECT o_orderpriority AS flow, 't:' || o_orderkey AS task,
               CAST(floor(o_totalprice / 100) AS BIGINT) - 500 AS detected_ms
        FROM {orders} WHERE o_totalprice > 20000""",
    "expected": """
        SELECT event_id AS pos, 't:' || (user_id * 100 + CAST(floor(value) AS BIGINT)) AS task FROM {events}""",
    "outside": """
        SELECT o_orderpriority AS flow, 'd:' || o_orderkey AS dataset,
               CASE WHEN o_totalprice > 400000 THEN 's:N' ELSE 's:' || o_orderstatus END AS schema_fp,
               CASE WHEN o_totalprice > 350000 THEN 'p:' || o_custkey WHEN o_totalprice > 320000 THEN 'z:1'
                    ELSE 'c:' || CAST(floor(o_totalprice) AS BIGINT) END AS content_fp
        FROM {orders} WHERE o_orderstatus <> 'F' OR o_totalprice > 200000""",
    "trace": """
        SELECT 'u:' || user_id AS flow, event_id AS seq, ts AS at,
               CASE event_type WHEN 'view' THEN 'read' WHEN 'click' THEN 'compare' WHEN 'signup' THEN 'write'
                    WHEN 'purchase' THEN 'walk' ELSE 'done' END AS phase
        FROM {events}""",
    # A journey per order line, and the nations as the zones it runs between; some zone ids resolve to nothing.
    "trips": """
        SELECT l.l_orderkey AS trip_id, o.o_orderdate + INTERVAL '1' HOUR * CAST(l.l_partkey % 24 AS INT) AS pickup_datetime,
               l.l_shipdate AS dropoff_datetime, l.l_linenumber AS passenger_count,
               CAST(l.l_quantity AS DECIMAL(18, 2)) * CAST(0.2 AS DECIMAL(18, 2)) AS trip_distance,
               CAST(l.l_extendedprice AS DECIMAL(18, 2)) AS fare_amount,
               CAST(l.l_extendedprice AS DECIMAL(18, 2)) * CAST(l.l_discount AS DECIMAL(18, 2)) AS tip_amount,
               CAST(l.l_extendedprice AS DECIMAL(18, 2)) * CAST(1 + l.l_tax AS DECIMAL(18, 2)) AS total_amount,
               CASE WHEN l.l_returnflag = 'N' THEN 1 WHEN l.l_returnflag = 'A' THEN 2 WHEN l.l_linestatus = 'O' THEN 3 ELSE 4 END AS payment_type,
               CASE WHEN s.s_acctbal < 0 THEN 99 ELSE s.s_nationkey END AS pickup_zone_id,
               CASE WHEN c.c_acctbal < 0 THEN 98 ELSE c.c_nationkey END AS dropoff_zone_id,
               l.l_partkey, l.l_suppkey, l.l_quantity
        FROM {lineitem} l JOIN {orders} o ON o.o_orderkey = l.l_orderkey JOIN {supplier} s ON s.s_suppkey = l.l_suppkey
        JOIN {customer} c ON c.c_custkey = o.o_custkey""",
    "zones": """
        SELECT n_nationkey AS zone_id, '  ' || n_name || CASE WHEN n_regionkey = 2 THEN ' Airport ' ELSE ' ' END AS zone_name,
               r_name AS borough, 'yellow' AS service_zone
        FROM {nation} JOIN {region} ON n_regionkey = r_regionkey""",
    "raw_orders": """
        SELECT o_orderkey AS order_id, '  ' || CASE WHEN o_totalprice > 250000 THEN upper(c_name) ELSE replace(c_name, '#', '   ') END || ' ' || lower(c_mktsegment) AS customer,
               CASE WHEN o_orderpriority = '5-LOW' THEN NULL WHEN o_totalprice < 20000 THEN -o_totalprice ELSE o_totalprice END AS order_total,
               o_orderdate AS order_date
        FROM {orders} JOIN {customer} ON c_custkey = o_custkey""",
    # The append-only ledger: one record per order and line number; some numbers are missing.
    "ledger": """
        SELECT 'attestation' AS kind, 'k:' || l_orderkey AS ledger_key, l_linenumber AS seq, max(l_shipdate) AS at,
               min(l_partkey) AS body
        FROM {lineitem} GROUP BY l_orderkey, l_linenumber""",
    # One change record per part of a board's work; a cheap one was written badly and cannot be read.
    "change_records": """
        SELECT o_orderpriority AS flow, o_orderkey AS seq, o_orderdate AS at,
               CASE WHEN o_totalprice < 5000 THEN '{{not json' ELSE
                 '{{"event":"' || CASE WHEN o_orderstatus = 'F' THEN 'marked' ELSE 'cleared' END
                 || '","elapsedMs":' || CAST(floor(o_totalprice / 100) AS BIGINT) || '}}' END AS body
        FROM {orders}""",
    # Table-level lineage as the catalog holds it, with column edges mixed in.
    "lineage": """
        SELECT DISTINCT 'urn:li:dataset:d' || k AS downstream, 'urn:li:dataset:d' || d AS upstream FROM {line_reads}
        UNION ALL
        SELECT DISTINCT 'urn:li:schemaField:d' || k || '.c' AS downstream, 'urn:li:dataset:d' || d AS upstream
        FROM {line_reads} WHERE line = 3""",
    # A customer in debt who closes the account asks to be forgotten, some within no stated bound.
    "requests": """
        SELECT 'r:' || c_custkey AS request, c_custkey,
               CASE WHEN c_custkey % 7 > 0 THEN CAST(c_custkey % 7 AS INT) END AS hops FROM {customer} WHERE c_acctbal < 0""",
    "request_identifiers": """
        SELECT request, 'cust_' || c_custkey AS identifier FROM {requests}
        UNION ALL SELECT request, 'mail_' || c_custkey AS identifier FROM {requests}""",
    "seeds": """
        SELECT r.request, 'urn:li:dataset:d' || o.o_orderkey AS asset
        FROM {requests} r JOIN {orders} o ON o.o_custkey = r.c_custkey""",
    "keys": """
        SELECT 'key_' || s_suppkey AS key_id, s_name AS attestor, DATE '1995-06-01' AS not_before,
               CASE WHEN s_acctbal < 0 THEN 'compromised' WHEN s_acctbal > 9000 THEN 'retired' ELSE 'active' END AS state,
               CASE WHEN s_acctbal < 0 OR s_acctbal > 9000 THEN DATE '1998-01-01' END AS state_at
        FROM {supplier}""",
    "key_scopes": """
        SELECT 'key_' || s_suppkey AS key_id, 'urn:li:dataset:d*' AS scope FROM {supplier} WHERE s_nationkey < 15
        UNION ALL
        SELECT 'key_' || s_suppkey AS key_id, 'urn:li:dataset:d' || s_nationkey || '*' AS scope FROM {supplier} WHERE s_nationkey >= 10
        UNION ALL
        SELECT 'key_' || s_suppkey AS key_id, 'urn:li:dataset:d' || s_suppkey AS scope FROM {supplier}""",
    "table_lineage": """
        SELECT downstream, upstream FROM {lineage} WHERE downstream LIKE 'urn:li:dataset:%' AND upstream LIKE 'urn:li:dataset:%'""",
    # Evidence is filed about the seeds and what is built directly on them.
    "evidence": """
        SELECT request, asset FROM {seeds}
        UNION SELECT s.request, t.downstream AS asset FROM {seeds} s JOIN {table_lineage} t ON t.upstream = s.asset""",
    "evidence_lines": """
        SELECT 'urn:li:dataset:d' || l_orderkey AS asset, l_linenumber AS line, CAST(floor((l_linenumber + 1) / 2) AS INT) AS vno,
               min(l_returnflag) AS flag, max(l_linestatus) AS side, min(l_shipdate) AS at, min(l_suppkey) AS supp,
               min(l_quantity) AS qty, min(l_discount) AS disc, min(l_tax) AS tax
        FROM {lineitem} GROUP BY l_orderkey, l_linenumber""",
    "attestations": """
        SELECT v.request || '|' || v.asset || '|' || e.line AS att_id, v.request, v.asset, 'v' || e.vno AS version,
               CASE WHEN e.side = 'F' THEN 'direct' ELSE 'rebuild' END AS kind,
               CASE WHEN e.side = 'F' THEN CASE WHEN e.flag = 'R' AND e.line > 5 AND e.qty < 12 THEN 'present' ELSE 'absent' END END AS result,
               CASE WHEN e.side = 'O' THEN CASE WHEN e.qty < 4 THEN 'merge' WHEN e.qty < 6 THEN 'append' WHEN e.qty < 8 THEN 'partition' ELSE 'full' END END AS materialization,
               CASE WHEN e.side = 'O' THEN CASE WHEN e.tax > 0.075 THEN 0 ELSE 1 END END AS sole_producer,
               CASE WHEN e.side = 'F' THEN CASE WHEN e.qty > 38 THEN 'partitions' ELSE 'whole' END END AS scope_kind,
               CASE WHEN e.side = 'F' AND e.qty > 38 THEN 2 END AS scope_total,
               'key_' || e.supp AS key_id, k.attestor, e.at, e.line AS seq,
               CASE WHEN e.disc > 0.045 AND e.disc < 0.055 THEN 0 ELSE 1 END AS signature_valid,
               CASE WHEN e.tax < 0.005 THEN 1 ELSE 0 END AS retracted
        FROM {evidence} v JOIN {evidence_lines} e ON e.asset = v.asset JOIN {keys} k ON k.key_id = 'key_' || e.supp""",
    "att_identifiers": """
        SELECT v.request || '|' || v.asset || '|' || e.line AS att_id, i.identifier
        FROM {evidence} v JOIN {evidence_lines} e ON e.asset = v.asset JOIN {request_identifiers} i ON i.request = v.request
        WHERE e.side = 'F' AND (e.flag <> 'N' OR i.identifier LIKE 'cust%') AND (e.disc < 0.085 OR i.identifier LIKE 'mail%')""",
    "att_partitions": """
        SELECT v.request || '|' || v.asset || '|' || e.line AS att_id, CASE WHEN e.line = 2 * e.vno THEN 'p2' ELSE 'p1' END AS part_name
        FROM {evidence} v JOIN {evidence_lines} e ON e.asset = v.asset WHERE e.side = 'F' AND e.qty > 38""",
    # A rebuild declares the recorded upstreams, sometimes too few; an even line over 24 rewrote its own prior version.
    "att_inputs": """
        SELECT v.request || '|' || v.asset || '|' || e.line AS att_id, t.upstream AS input_asset, 'v' || e.vno AS input_version
        FROM {evidence} v JOIN {evidence_lines} e ON e.asset = v.asset JOIN {table_lineage} t ON t.downstream = v.asset
        WHERE e.side = 'O' AND NOT (e.qty > 24 AND e.line = 2 * e.vno) AND (e.qty > 14 OR t.upstream < v.asset)
        UNION ALL
        SELECT v.request || '|' || v.asset || '|' || e.line AS att_id, v.asset AS input_asset, 'v' || (e.vno - 1) AS input_version
        FROM {evidence} v JOIN {evidence_lines} e ON e.asset = v.asset
        WHERE e.side = 'O' AND e.qty > 24 AND e.line = 2 * e.vno""",
    "challenges": """
        SELECT 'n:' || v.request || '|' || v.asset || '|' || e.line AS nonce, v.request,
               CASE WHEN e.qty > 48 THEN 'urn:li:dataset:other' ELSE v.asset END AS asset,
               CASE WHEN e.disc > 0.065 AND e.disc < 0.075 THEN DATE '2001-06-01' ELSE DATE '1995-01-01' END AS issued_at,
               CASE WHEN e.tax > 0.065 AND e.tax < 0.075 THEN DATE '2001-07-01' ELSE DATE '2002-06-01' END AS expires_at,
               CASE WHEN e.qty < 3 THEN 1 ELSE 0 END AS consumed
        FROM {evidence} v JOIN {evidence_lines} e ON e.asset = v.asset WHERE e.qty <> 25""",
    # What a submission says beside what was filed about it.
    "submissions": """
        SELECT a.*, 'n:' || CASE WHEN e.qty = 30 THEN v.request || '|' || v.asset || '|' || 1 ELSE a.att_id END AS nonce,
               CASE WHEN e.qty = 31 THEN 'Supplier#none' ELSE a.attestor END AS claimed_attestor,
               CASE WHEN e.qty = 32 THEN 'key_none' ELSE a.key_id END AS signed_key,
               CASE WHEN e.qty = 33 THEN 'r:none' ELSE a.request END AS said_request,
               CASE WHEN e.qty = 34 THEN 'urn:li:dataset:elsewhere' ELSE a.asset END AS filed_asset
        FROM {attestations} a JOIN {evidence} v ON v.request = a.request AND v.asset = a.asset
        JOIN {evidence_lines} e ON e.asset = a.asset AND e.line = a.seq""",
}


def dependencies(text: str) -> list[str]:
    return list(dict.fromkeys(name for _, name, _, _ in Formatter().parse(text) if name))


class Estate:
    """The derived views as DataFrames over one directory of Parquet tables."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir
        self._made: dict[str, DataFrame] = {}

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_") or name in ("spark", "sf_dir"):
            raise AttributeError(name)
        if name not in self._made:
            if name in VIEWS:
                text = VIEWS[name]
                self._made[name] = self.spark.sql(
                    text, **{dep: getattr(self, dep) for dep in dependencies(text)}
                )
            elif name in TABLES:
                self._made[name] = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
            else:
                raise AttributeError(name)
        return self._made[name]

    def share(self, *names: str) -> None:
        """Write these views once, in this order; views made after this read what was written."""
        for name in names:
            self._made[name] = materialize(getattr(self, name), name)


def oracle(query: str, **extra: str) -> str:
    """`query` for DuckDB, with every view it names in braces spelled out as a CTE."""
    known = {**VIEWS, **extra}
    order: list[str] = []

    def visit(text: str) -> None:
        for name in dependencies(text):
            if name in known and name not in order:
                visit(known[name])
                order.append(name)

    def plain(text: str) -> str:
        return text.format(**{name: name for name in dependencies(text)})

    visit(query)
    if not order:
        return plain(query)
    ctes = ",\n".join(f"{name} AS MATERIALIZED ({plain(known[name])})" for name in order)
    body = plain(query).strip()
    if body.startswith("WITH"):
        body = f"SELECT * FROM ({body})"
    return f"WITH RECURSIVE {ctes}\n{body}"