"""Coverage and attestation admission over the derived evidence."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import admission as A
from tidemark.operators import coverage as V
from tidemark.operators import graph as G
from tidemark.plans.graph_queries import REACHED
from tidemark.plans.registry import query
from tidemark.session import materialize

NODE = "request, asset, version"


def evidence(e, *read: str) -> V.Evidence:
    """The evidence, what every derivation reads several times written once; with `read`, only these views."""
    e.share("lineage", "evidence", "evidence_lines", *(read or ("attestations", "att_identifiers", "att_partitions")))
    edges = G.table_edges(e.lineage)
    inputs = e.att_inputs.distinct()
    return V.Evidence(
        e.request_identifiers,
        G.reach(e.lineage, e.seeds, e.requests, edges=edges),
        e.lineage,
        e.attestations,
        e.att_identifiers,
        e.att_partitions,
        inputs if read else materialize(inputs, "inputs"),
        e.keys,
        edges[0],
    )


KERNEL = {
    **REACHED,
    "valid_key": "SELECT a.* FROM {attestations} a JOIN {keys} k ON k.key_id = a.key_id WHERE k.state <> 'compromised'",
    "usable": "SELECT * FROM {valid_key} WHERE signature_valid = 1 AND retracted = 0",
    "curr": """
        SELECT r.request, r.asset, coalesce(max_by(a.version, (a.at, a.seq)), 'unknown') AS version
        FROM {reached} r LEFT JOIN {valid_key} a ON a.request = r.request AND a.asset = r.asset GROUP BY 1, 2""",
    "ksize": "SELECT request, count(*) AS k FROM {request_identifiers} GROUP BY 1",
    "absent": "SELECT * FROM {usable} WHERE kind = 'direct' AND result = 'absent'",
    "present": "SELECT * FROM {usable} WHERE kind = 'direct' AND result = 'present'",
    "full_checks": """
        SELECT a.* FROM {absent} a JOIN {ksize} k ON k.request = a.request
        WHERE (SELECT count(DISTINCT i.identifier) FROM {att_identifiers} i JOIN {request_identifiers} q ON q.identifier = i.identifier
               WHERE i.att_id = a.att_id AND q.request = a.request) = k.k""",
    "part_cover": """
        SELECT f.request, f.asset, f.version, count(DISTINCT p.part_name) AS covered, max(f.scope_total) AS total
        FROM {full_checks} f LEFT JOIN {att_partitions} p ON p.att_id = f.att_id WHERE f.scope_kind = 'partitions' GROUP BY 1, 2, 3""",
    "direct_ok": """
        SELECT request, asset, version FROM {full_checks} WHERE scope_kind = 'whole'
        UNION SELECT request, asset, version FROM {part_cover} WHERE covered >= total""",
    "undeclared": """
        SELECT a.att_id, a.request, a.asset, a.version, t.upstream FROM {usable} a JOIN {table_edges} t ON t.downstream = a.asset
        WHERE a.kind = 'rebuild' AND NOT EXISTS (SELECT 1 FROM {att_inputs} i WHERE i.att_id = a.att_id AND i.input_asset = t.upstream)""",
    "in_count": "SELECT att_id, count(*) AS n, min(input_asset) AS ia, min(input_version) AS iv FROM (SELECT DISTINCT * FROM {att_inputs}) GROUP BY 1",
    "checked": """
        SELECT a.att_id, a.request, a.asset, a.version, a.materialization,
               CASE WHEN a.materialization = 'full' THEN 1 ELSE 0 END AS total, CASE WHEN a.sole_producer = 1 THEN 1 ELSE 0 END AS sole,
               CASE WHEN n = 1 AND ia = a.asset AND iv <> a.version THEN 1 ELSE 0 END AS self_rebuild,
               CASE WHEN t.asset IS NOT NULL THEN 1 ELSE 0 END AS recorded,
               CASE WHEN t.asset IS NOT NULL AND u.att_id IS NULL THEN 1 ELSE 0 END AS closed
        FROM {usable} a LEFT JOIN {in_count} c ON c.att_id = a.att_id
        LEFT JOIN (SELECT DISTINCT downstream AS asset FROM {table_edges}) t ON t.asset = a.asset
        LEFT JOIN (SELECT DISTINCT att_id FROM {undeclared}) u ON u.att_id = a.att_id WHERE a.kind = 'rebuild'""",
    "barred": "SELECT DISTINCT request, asset, version FROM {present}",
    "sound": "SELECT att_id, request, asset, version FROM {checked} WHERE total = 1 AND sole = 1 AND (self_rebuild = 1 OR closed = 1)",
    "e0": "SELECT * FROM {direct_ok} EXCEPT SELECT * FROM {barred}",
}
ROUNDS = 10
for _n in range(1, ROUNDS + 1):
    KERNEL[f"e{_n}"] = f"""
        SELECT * FROM {{e{_n - 1}}} UNION (
          SELECT s.request, s.asset, s.version FROM {{sound}} s WHERE NOT EXISTS (
            SELECT 1 FROM {{att_inputs}} i LEFT JOIN {{e{_n - 1}}} p ON p.request = s.request AND p.asset = i.input_asset AND p.version = i.input_version
            WHERE i.att_id = s.att_id AND p.asset IS NULL)
          EXCEPT SELECT * FROM {{barred}})"""
KERNEL |= {
    "attested": f"SELECT * FROM {{e{ROUNDS}}}",
    "mention": """
        SELECT request, asset, version, min(m.at) AS first_at FROM (
          SELECT u.request, u.asset, u.version, u.at FROM {usable} u UNION ALL
          SELECT u.request, i.input_asset, i.input_version, u.at FROM {usable} u JOIN {att_inputs} i ON i.att_id = u.att_id) m GROUP BY 1, 2, 3""",
    "elsewhere": """
        SELECT c.request, c.asset, max(p.at) AS found_at, max_by(p.version, (p.at, p.version)) AS found_in
        FROM {curr} c JOIN {present} p ON p.request = c.request AND p.asset = c.asset AND p.version <> c.version GROUP BY 1, 2""",
    "states": """
        SELECT request, asset, version, CASE WHEN here OR still THEN 'CONTRADICTED' WHEN ok THEN 'ATTESTED' ELSE 'UNPROVEN' END AS state,
               CASE WHEN here THEN version WHEN still THEN found_in END AS found_in FROM (
          SELECT c.request, c.asset, c.version, b.asset IS NOT NULL AS here, t.asset IS NOT NULL AS ok, e.found_in,
                 e.found_in IS NOT NULL AND NOT coalesce(t.asset IS NOT NULL AND m.first_at > e.found_at, false) AS still
          FROM {curr} c LEFT JOIN {barred} b ON b.request = c.request AND b.asset = c.asset AND b.version = c.version
          LEFT JOIN {attested} t ON t.request = c.request AND t.asset = c.asset AND t.version = c.version
          LEFT JOIN {mention} m ON m.request = c.request AND m.asset = c.asset AND m.version = c.version
          LEFT JOIN {elsewhere} e ON e.request = c.request AND e.asset = c.asset)""",
    "open_nodes": "SELECT request, asset, version FROM {states} WHERE state = 'UNPROVEN'",
    "id_reach": """
        SELECT n.request, n.asset, n.version, q.identifier, count(a.att_id) AS hits, count(*) FILTER (a.scope_kind = 'whole') AS wholes,
               count(DISTINCT p.part_name) FILTER (a.scope_kind = 'partitions') AS covered, max(a.scope_total) AS total
        FROM (SELECT DISTINCT o.* FROM {open_nodes} o JOIN {absent} a ON a.request = o.request AND a.asset = o.asset AND a.version = o.version) n
        JOIN {request_identifiers} q ON q.request = n.request
        LEFT JOIN (SELECT x.*, i.identifier FROM {absent} x JOIN {att_identifiers} i ON i.att_id = x.att_id) a
          ON a.request = n.request AND a.asset = n.asset AND a.version = n.version AND a.identifier = q.identifier
        LEFT JOIN {att_partitions} p ON p.att_id = a.att_id GROUP BY 1, 2, 3, 4""",
    "residue": f"""
        SELECT {NODE}, 1 AS rank, 'predicate-gap' AS kind, identifier AS detail FROM {{id_reach}} WHERE hits = 0
        UNION SELECT {NODE}, 2, 'predicate-split', CASE WHEN wholes > 0 THEN identifier ELSE identifier || ' ' || covered || '/' || total END FROM {{id_reach}}
          WHERE ({NODE}) NOT IN (SELECT ({NODE}) FROM {{id_reach}} WHERE hits = 0) AND ({NODE}) NOT IN (SELECT ({NODE}) FROM {{full_checks}})
        UNION SELECT {NODE}, 3, 'partitions-uncovered', covered || '/' || total FROM {{part_cover}} SEMI JOIN {{open_nodes}} USING ({NODE}) WHERE covered < total
          AND ({NODE}) NOT IN (SELECT ({NODE}) FROM {{full_checks}} WHERE scope_kind = 'whole')
        UNION SELECT {NODE}, 4, 'not-sole-producer', NULL FROM {{checked}} SEMI JOIN {{open_nodes}} USING ({NODE}) WHERE sole = 0
        UNION SELECT {NODE}, 5, 'not-total', materialization FROM {{checked}} SEMI JOIN {{open_nodes}} USING ({NODE}) WHERE total = 0
        UNION SELECT {NODE}, 6, 'no-recorded-lineage', NULL FROM {{checked}} SEMI JOIN {{open_nodes}} USING ({NODE}) WHERE self_rebuild = 0 AND recorded = 0
        UNION SELECT {NODE}, 7, 'closure-mismatch', upstream FROM {{undeclared}} SEMI JOIN {{open_nodes}} USING ({NODE})
          WHERE att_id IN (SELECT att_id FROM {{checked}} WHERE self_rebuild = 0)
        UNION SELECT c.request, c.asset, c.version, 8, 'unattested-input', i.input_asset || '@' || i.input_version
          FROM {{checked}} c SEMI JOIN {{open_nodes}} o ON o.request = c.request AND o.asset = c.asset AND o.version = c.version
          JOIN {{att_inputs}} i ON i.att_id = c.att_id
          LEFT JOIN {{attested}} t ON t.request = c.request AND t.asset = i.input_asset AND t.version = i.input_version WHERE t.asset IS NULL
        UNION SELECT o.request, o.asset, o.version, 9, 'attested-other-version', t.version FROM {{open_nodes}} o JOIN {{attested}} t
          ON t.request = o.request AND t.asset = o.asset WHERE t.version <> o.version
        UNION SELECT o.request, o.asset, o.version, 10, 'no-attestation', NULL FROM {{open_nodes}} o
          WHERE NOT EXISTS (SELECT 1 FROM {{usable}} u WHERE u.request = o.request AND u.asset = o.asset AND u.version = o.version)
            AND NOT EXISTS (SELECT 1 FROM {{valid_key}} u WHERE u.request = o.request AND u.asset = o.asset AND u.version = o.version AND u.signature_valid = 0 AND u.retracted = 0)
            AND NOT EXISTS (SELECT 1 FROM {{attested}} t WHERE t.request = o.request AND t.asset = o.asset AND t.version <> o.version)
        UNION SELECT {NODE}, 11, 'unverified-signature', attestor FROM {{valid_key}} SEMI JOIN {{open_nodes}} USING ({NODE}) WHERE signature_valid = 0 AND retracted = 0""",
}


@query("e1_node_set", f"""
    SELECT {NODE} FROM {{attestations}} UNION SELECT a.request, i.input_asset, i.input_version FROM {{att_inputs}} i JOIN {{attestations}} a ON a.att_id = i.att_id
    UNION SELECT {NODE} FROM {{curr}}""", **KERNEL)
def _(e):
    return V.node_set(evidence(e, "attestations"))


@query("e2_usable_records", "SELECT att_id, request, asset, version FROM {usable}", **KERNEL)
def _(e):
    return V.usable(e.attestations, e.keys).select("att_id", "request", "asset", "version")


@query("e3_direct_checks", f"SELECT DISTINCT {NODE} FROM {{full_checks}} WHERE scope_kind = 'whole'", **KERNEL)
def _(e):
    full = V.searched_all(V.absent_checks(V.usable(e.attestations, e.keys)), _light(e))
    return full.filter("scope_kind = 'whole'").select("request", "asset", "version").distinct()


def _light(e) -> V.Evidence:
    """Evidence for operators that need no walk."""
    return V.Evidence(
        e.request_identifiers, e.evidence, e.lineage, e.attestations, e.att_identifiers, e.att_partitions, e.att_inputs, e.keys
    )


@query("e4_current_versions", "SELECT * FROM {curr}", **KERNEL)
def _(e):
    return V.current_versions(G.reach(e.lineage, e.seeds, e.requests), e.attestations, e.keys)


@query("e5_partition_cover", f"SELECT {NODE}, covered, total FROM {{part_cover}}", **KERNEL)
def _(e):
    full = V.searched_all(V.absent_checks(V.usable(e.attestations, e.keys)), _light(e))
    return V.partition_cover(full, _light(e))


@query("e8_e9_e10_e11_rebuild_checks", "SELECT * FROM {checked}", **KERNEL)
def _(e):
    return V.rebuild_checks(V.usable(e.attestations, e.keys), _light(e))


@query("e10_undeclared_upstreams", "SELECT att_id, request, asset, version, upstream FROM {undeclared}", **KERNEL)
def _(e):
    rebuilds = V.usable(e.attestations, e.keys).filter("kind = 'rebuild'")
    return V.undeclared_upstreams(rebuilds, _light(e)).select("att_id", "request", "asset", "version", "upstream")


@query("e12_attested_fixpoint", f"SELECT {NODE} FROM {{attested}}", **KERNEL)
def _(e):
    return V.derive(evidence(e)).attested.select("request", "asset", "version")


@query("e13_e14_states", "SELECT * FROM {states}", **KERNEL)
def _(e):
    return V.states(V.derive(evidence(e)))


@query("e14_first_mentions", "SELECT * FROM {mention}", **KERNEL)
def _(e):
    records = V.usable(e.attestations, e.keys)
    return V.first_mentions(V.Derived(_light(e), records, None, None, None, None))


@query("e16_residue", "SELECT * FROM {residue}", **KERNEL)
def _(e):
    return V.residue(V.derive(evidence(e)))


@query("e6_predicate_gaps", f"SELECT {NODE}, detail FROM {{residue}} WHERE kind = 'predicate-gap'", **KERNEL)
def _(e):
    return V.residue(V.derive(evidence(e)), "predicate-gap").select("request", "asset", "version", "detail")


@query("e7_predicate_splits", f"SELECT {NODE}, detail FROM {{residue}} WHERE kind = 'predicate-split'", **KERNEL)
def _(e):
    return V.residue(V.derive(evidence(e)), "predicate-split").select("request", "asset", "version", "detail")


@query("e17_attested_elsewhere", f"SELECT {NODE}, detail FROM {{residue}} WHERE kind = 'attested-other-version'", **KERNEL)
def _(e):
    return V.residue(V.derive(evidence(e)), "attested-other-version").select("request", "asset", "version", "detail")


@query(
    "e18_summary",
    """SELECT request, count(*) AS total, count(*) FILTER (state = 'ATTESTED') AS attested, count(*) FILTER (state = 'UNPROVEN') AS unproven,
              count(*) FILTER (state = 'CONTRADICTED') AS contradicted FROM {states} GROUP BY 1""",
    **KERNEL,
)
def _(e):
    return V.summary(V.states(V.derive(evidence(e))))


@query(
    "e19_assurance",
    """WITH f AS (SELECT a.* FROM {attestations} a SEMI JOIN {reached} r ON r.request = a.request AND r.asset = a.asset)
       SELECT q.request, coalesce(q.hops, 3) AS hops_walked, (SELECT count(*) FROM {reached} r WHERE r.request = q.request) AS assets_reached,
              1 + (SELECT count(*) FROM f WHERE f.request = q.request) AS evidence_records,
              (SELECT count(*) FROM f JOIN {keys} k ON k.key_id = f.key_id WHERE f.request = q.request AND k.state = 'compromised') AS dropped_for_keys
       FROM {requests} q""",
    **REACHED,
)
def _(e):
    return V.assurance(evidence(e, "attestations"), e.requests)


STEP_SQL = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in V.NEXT_STEP.items())
PRIORITY_SQL = " ".join(f"WHEN '{k}' THEN {v}" for k, v in V.STEP_PRIORITY.items())
CALLER = "SELECT request, 'urn:li:dataset:d1*' AS scope FROM {requests} UNION ALL SELECT request, 'urn:li:dataset:d' || c_custkey AS scope FROM {requests}"


@query(
    "e20_obligations",
    f"""WITH f AS (SELECT {NODE}, min_by(kind, rank) AS kind FROM {{residue}} GROUP BY ALL),
             w AS (SELECT s.request, s.asset, s.version, s.state, CASE f.kind {STEP_SQL} ELSE 'unknown' END AS action
                   FROM {{states}} s LEFT JOIN f ON f.request = s.request AND f.asset = s.asset AND f.version = s.version WHERE s.state <> 'ATTESTED')
        SELECT w.*, CASE action {PRIORITY_SQL} END AS priority,
               CASE WHEN starts_with(asset, 'urn:li:dataset:d1') OR asset = 'urn:li:dataset:d' || substr(request, 3) THEN 1 ELSE 0 END AS in_scope FROM w""",
    **KERNEL,
)
def _(e):
    d = V.derive(evidence(e))
    wide = e.requests.select("request", F.lit("urn:li:dataset:d1*").alias("scope"))
    one = e.requests.select("request", F.concat(F.lit("urn:li:dataset:d"), F.col("c_custkey").cast("string")).alias("scope"))
    return V.obligations(V.states(d), V.residue(d), wide.union(one))


@query("e21_redacted_identifiers", "SELECT DISTINCT request, sha256(identifier) AS digest FROM {request_identifiers}")
def _(e):
    return V.redacted(e.request_identifiers)


@query(
    "e24_lineage_census",
    """SELECT request, CASE WHEN asset IN (SELECT downstream FROM {table_edges}) THEN 'cross-checkable'
              WHEN asset IN (SELECT upstream FROM {table_edges}) THEN 'source' ELSE 'unattestable' END AS class, count(*) AS assets
       FROM {reached} GROUP BY 1, 2""",
    **REACHED,
)
def _(e):
    return V.census(G.reach(e.lineage, e.seeds, e.requests), e.lineage)


@query(
    "e25_absence_check",
    """SELECT o_orderpriority, count(*) AS scanned, count(*) FILTER (CAST(o_custkey AS VARCHAR) IN (SELECT CAST(c_custkey AS VARCHAR) FROM {requests})
              OR CAST(o_orderkey AS VARCHAR) IN (SELECT CAST(c_custkey AS VARCHAR) FROM {requests})) AS matches FROM orders GROUP BY 1""",
)
def _(e):
    return V.absence_check(e.orders, ["o_custkey", "o_orderkey"], e.requests.select("c_custkey"), "o_orderpriority")


# -- joins named on their own ------------------------------------------------------------------


@query(
    "j6_scope_prefix_join",
    """SELECT DISTINCT a.key_id, a.asset FROM {attestations} a JOIN {key_scopes} s ON s.key_id = a.key_id
       WHERE CASE WHEN s.scope LIKE '%*' THEN starts_with(a.asset, rtrim(s.scope, '*')) ELSE a.asset = s.scope END""",
)
def _(e):
    return V.in_scope(e.attestations.select("key_id", "asset").distinct(), e.key_scopes, ["key_id"])


@query(
    "j7_challenge_window",
    "SELECT s.att_id, s.nonce FROM {submissions} s JOIN {challenges} c ON c.nonce = s.nonce WHERE s.at BETWEEN c.issued_at AND c.expires_at",
)
def _(e):
    return A.in_challenge_window(e.submissions, e.challenges).select("att_id", "nonce")


@query("j9_records_on_reached_assets", "SELECT a.att_id FROM {attestations} a SEMI JOIN {reached} r ON r.request = a.request AND r.asset = a.asset", **REACHED)
def _(e):
    reached = G.reach(e.lineage, e.seeds, e.requests)
    return e.attestations.join(reached, ["request", "asset"], "left_semi").select("att_id")


@query("j10_searched_all_identifiers", "SELECT att_id FROM {full_checks}", **KERNEL)
def _(e):
    return V.searched_all(V.absent_checks(V.usable(e.attestations, e.keys)), _light(e)).select("att_id")


# -- admission ---------------------------------------------------------------------------------

NOW = "DATE '2001-09-01'"
VERIFIED = {
    "scoped": """SELECT DISTINCT a.signed_key, a.asset FROM {submissions} a JOIN {key_scopes} s ON s.key_id = a.signed_key
        WHERE CASE WHEN s.scope LIKE '%*' THEN starts_with(a.asset, rtrim(s.scope, '*')) ELSE a.asset = s.scope END""",
    "judged": f"""
        SELECT s.att_id, s.request, s.asset, s.nonce, s.seq, k.key_id IS NOT NULL AND c.nonce IS NOT NULL AS open, list_filter([
          CASE WHEN k.key_id IS NULL THEN 'unknown-key' END,
          CASE WHEN k.key_id IS NOT NULL AND s.signature_valid = 0 THEN 'bad-signature' END,
          CASE WHEN s.at < k.not_before THEN 'key-not-yet-valid' END,
          CASE WHEN k.key_id IS NOT NULL AND s.at > {NOW} THEN 'dated-in-the-future' END,
          CASE WHEN k.state = 'compromised' THEN 'key-compromised' END,
          CASE WHEN k.state = 'retired' AND greatest(s.at, c.issued_at) > k.state_at THEN 'key-retired-before-signing' END,
          CASE WHEN s.claimed_attestor <> k.attestor THEN 'attestor-mismatch' END,
          CASE WHEN k.key_id IS NOT NULL AND p.asset IS NULL THEN 'out-of-scope' END,
          CASE WHEN k.key_id IS NOT NULL AND c.nonce IS NULL THEN 'unknown-challenge' END,
          CASE WHEN k.key_id IS NOT NULL AND c.nonce IS NOT NULL AND c.consumed = 1 THEN 'challenge-replayed' END], lambda x: x IS NOT NULL) AS before, list_filter([
          CASE WHEN k.key_id IS NOT NULL AND {NOW} > c.expires_at THEN 'challenge-expired' END,
          CASE WHEN k.key_id IS NOT NULL AND (c.request <> s.request OR c.asset <> s.asset) THEN 'challenge-mismatch' END,
          CASE WHEN s.said_request <> s.request THEN 'request-mismatch' END], lambda x: x IS NOT NULL) AS after
        FROM {{submissions}} s LEFT JOIN {{keys}} k ON k.key_id = s.signed_key LEFT JOIN {{challenges}} c ON c.nonce = s.nonce
        LEFT JOIN {{scoped}} p ON p.signed_key = s.signed_key AND p.asset = s.asset""",
    # The first record with nothing else wrong spends its nonce; what arrives later for the same asset replays it.
    "spent": """SELECT request, asset, nonce, min((seq, att_id)) AS spent FROM {judged} WHERE len(before) + len(after) = 0 GROUP BY ALL""",
    "again": """SELECT j.att_id, j.nonce FROM {judged} j JOIN {spent} p ON p.request = j.request AND p.asset = j.asset AND p.nonce = j.nonce
        WHERE j.open AND (j.seq, j.att_id) > p.spent""",
    "verified": """
        SELECT j.att_id, j.before || CASE WHEN g.att_id IS NOT NULL AND NOT list_contains(j.before, 'challenge-replayed')
          THEN ['challenge-replayed'] ELSE [] END || j.after AS failures
        FROM {judged} j LEFT JOIN {again} g ON g.att_id = j.att_id""",
}


def verified(e):
    e.share("evidence", "evidence_lines")
    now = F.lit("2001-09-01").cast("date")
    return A.validate_attestations(e.submissions, e.keys, e.key_scopes, e.challenges, now)


@query("a3_a8_validate_attestations", "SELECT att_id, array_to_string(failures, ',') AS failures FROM {verified}", **VERIFIED)
def _(e):
    return verified(e).select("att_id", F.array_join("failures", ",").alias("failures"))


def _failures(name: str, *kinds: str) -> None:
    listed = ", ".join(f"'{k}'" for k in kinds)
    sql = f"SELECT att_id, failure FROM (SELECT att_id, unnest(failures) AS failure FROM {{verified}}) WHERE failure IN ({listed})"

    @query(name, sql, **VERIFIED)
    def _(e):
        each = verified(e).select("att_id", F.explode("failures").alias("failure"))
        return each.filter(F.col("failure").isin(*kinds))


_failures("a3_unknown_keys", "unknown-key")
_failures("a4_key_lifetime", "key-not-yet-valid", "dated-in-the-future", "key-compromised", "key-retired-before-signing")
_failures("a5_attestor_mismatch", "attestor-mismatch")
_failures("a6_out_of_scope", "out-of-scope")
_failures("a7_challenge_faults", "unknown-challenge", "challenge-replayed", "challenge-expired", "challenge-mismatch")
_failures("a8_request_mismatch", "request-mismatch")


@query("a7_replayed_nonces", "SELECT att_id, nonce FROM {again}", **VERIFIED)
def _(e):
    now = F.lit("2001-09-01").cast("date")
    return A.replays(A.judge(e.submissions, e.keys, e.key_scopes, e.challenges, now).filter("open"))


@query(
    "a10_dropped_for_keys",
    "SELECT a.att_id, a.request, a.asset, a.attestor, 'key-compromised' AS reason FROM {attestations} a JOIN {keys} k ON k.key_id = a.key_id WHERE k.state = 'compromised'",
)
def _(e):
    return V.key_drops(e.attestations, e.keys)


OPENING = {
    "opening": "SELECT 'r:' || user_id AS request, ts AS opened_at, event_id AS entry FROM {events} WHERE event_type = 'signup'",
}


@query(
    "a12_refuse_reopen",
    """SELECT request, opened_at, entry, CASE WHEN request IN (SELECT request FROM {requests}) OR row_number() OVER (PARTITION BY request ORDER BY opened_at, entry) > 1 THEN 1 ELSE 0 END AS refused
       FROM {opening}""",
    **OPENING,
)
def _(e):
    opening = e.events.filter("event_type = 'signup'").selectExpr("'r:' || user_id AS request", "ts AS opened_at", "event_id AS entry")
    return A.refuse_reopen(opening, e.requests)


@query(
    "a13_copy_mismatches",
    """SELECT att_id, unnest(list_filter([CASE WHEN key_id <> signed_key THEN 'recorded-keyid-mismatch' END,
              CASE WHEN nonce <> 'n:' || att_id THEN 'recorded-nonce-mismatch' END,
              CASE WHEN filed_asset <> asset THEN 'recorded-asset-mismatch' END], lambda x: x IS NOT NULL)) AS problem FROM {submissions}""",
)
def _(e):
    filed = e.submissions.select(
        "att_id",
        F.col("key_id").alias("filed_key"),
        F.col("nonce").alias("filed_nonce"),
        "filed_asset",
        "signed_key",
        F.concat(F.lit("n:"), "att_id").alias("signed_nonce"),
        F.col("asset").alias("signed_asset"),
    )
    return A.copy_mismatches(filed)


@query("a14_before_challenge", "SELECT s.att_id FROM {submissions} s JOIN {challenges} c ON c.nonce = s.nonce WHERE s.at < c.issued_at")
def _(e):
    return A.before_challenge(e.submissions, e.challenges).select("att_id")


#: Entries as a damaged export would hold them.
DAMAGED = {
    "bad_challenges": """SELECT nonce AS entry, CASE WHEN consumed = 1 THEN '' ELSE nonce END AS nonce, request, CASE WHEN asset LIKE '%other' THEN NULL ELSE asset END AS asset,
        issued_at, CASE WHEN expires_at < DATE '2002-01-01' THEN NULL ELSE expires_at END AS expires_at FROM {challenges}""",
    "bad_keys": "SELECT key_id AS entry, key_id, CASE WHEN state = 'retired' THEN '' ELSE attestor END AS attestor, not_before, CASE WHEN state <> 'compromised' THEN state END AS state FROM {keys}",
}


@query(
    "a15_unreadable_entries",
    """SELECT 'challenges' AS "where", entry, CASE WHEN nonce = '' THEN 'the challenge carries no nonce' WHEN asset IS NULL THEN 'the challenge names no request or no asset'
              ELSE 'the challenge carries no issue or expiry time' END AS problem FROM {bad_challenges} WHERE nonce = '' OR asset IS NULL OR expires_at IS NULL
       UNION ALL SELECT 'keys', entry, CASE WHEN attestor = '' THEN 'the key names no attestor' ELSE 'the key names no state' END FROM {bad_keys} WHERE attestor = '' OR state IS NULL""",
    **DAMAGED,
)
def _(e):
    c = e.challenges.select(
        F.col("nonce").alias("entry"),
        F.when(F.col("consumed") == 1, "").otherwise(F.col("nonce")).alias("nonce"),
        "request",
        F.when(~F.col("asset").endswith("other"), F.col("asset")).alias("asset"),
        "issued_at",
        F.when(F.col("expires_at") >= F.lit("2002-01-01").cast("date"), F.col("expires_at")).alias("expires_at"),
    )
    k = e.keys.select(
        F.col("key_id").alias("entry"),
        "key_id",
        F.when(F.col("state") == "retired", "").otherwise(F.col("attestor")).alias("attestor"),
        "not_before",
        F.when(F.col("state") != "compromised", F.col("state")).alias("state"),
    )
    cols = lambda df: {name: F.col(name) for name in df.columns}
    return A.unreadable(c, A.challenge_problem(cols(c)), "challenges").union(A.unreadable(k, A.key_problem(cols(k)), "keys"))


RECORDED = {
    **KERNEL,
    "filed": """SELECT request, asset, CASE WHEN state = 'ATTESTED' AND asset LIKE '%7' THEN 'UNPROVEN' ELSE state END AS state, version
        FROM {states} WHERE asset NOT LIKE '%13'""",
}


def filed_report(states):
    changed = F.when((F.col("state") == "ATTESTED") & F.col("asset").endswith("7"), "UNPROVEN").otherwise(F.col("state"))
    return states.filter(~F.col("asset").endswith("13")).select("request", "asset", changed.alias("state"), "version")


@query(
    "j8_e23_report_differences",
    """SELECT s.request, s.asset, f.state AS recorded_state, s.state AS state_now, CASE WHEN f.asset IS NULL THEN 'not recorded'
              WHEN f.state <> s.state THEN 'state differs' ELSE 'same' END AS outcome
       FROM {states} s LEFT JOIN {filed} f ON f.request = s.request AND f.asset = s.asset""",
    **RECORDED,
)
def _(e):
    now = V.states(V.derive(evidence(e)))
    return A.compare_reports(filed_report(now), now)


# -- record shapes -----------------------------------------------------------------------------


@query(
    "a1_a2_record_shapes",
    """SELECT att_id, CASE
         WHEN seq = 6 THEN 'missing required fields: attestor'
         WHEN seq = 7 AND kind = 'direct' THEN 'kind is neither direct nor rebuild'
         WHEN kind = 'direct' THEN CASE WHEN seq = 5 THEN 'result is neither absent nor present' WHEN seq = 4 THEN 'predicate names no identifiers'
           WHEN seq = 3 THEN 'predicate has no expression' WHEN scope_kind = 'partitions' AND seq = 2 THEN 'partition scope names no partitions'
           WHEN scope_kind = 'partitions' AND seq = 1 THEN 'partition scope has no positive total' END
         ELSE CASE WHEN materialization = 'append' THEN 'materialization is not one of full, merge, append, partition' WHEN seq = 1 THEN 'soleProducer is not stated'
           WHEN seq = 2 THEN 'no inputs array' WHEN seq = 4 THEN 'an input names no asset' WHEN seq = 3 THEN 'an input names no version' END END AS problem
       FROM {attestations}""",
)
def _(e):
    """Signed payloads as they would arrive, a good part of them damaged, parsed and judged."""
    seq, direct = F.col("seq"), F.col("kind") == "direct"
    text = lambda value, bad: F.when(bad, F.lit("")).otherwise(value)
    some = F.array(F.lit("cust"))
    predicate = F.struct(
        F.when(seq == 4, F.array().cast("array<string>")).otherwise(some).alias("identifiers"),
        text(F.lit("id = 'cust'"), seq == 3).alias("expression"),
        F.array(F.lit("id")).alias("columns"),
    )
    scope = F.struct(
        F.col("scope_kind").alias("kind"),
        F.when(seq != 2, F.array(F.lit("p1"))).alias("covered"),
        F.when(seq == 1, 0).otherwise(F.col("scope_total")).alias("total"),
    )
    inputs = F.array(F.struct(text(F.col("asset"), seq == 4).alias("asset"), text(F.lit("v1"), seq == 3).alias("version")))
    record = F.struct(
        F.when((seq == 7) & direct, "other").otherwise(F.col("kind")).alias("kind"),
        "request",
        "asset",
        "version",
        text(F.col("attestor"), seq == 6).alias("attestor"),
        F.col("at").cast("string").alias("at"),
        F.concat(F.lit("n:"), "att_id").alias("nonce"),
        F.when(direct, F.when(seq == 5, "maybe").otherwise(F.col("result"))).alias("result"),
        F.when(direct, predicate).alias("predicate"),
        F.when(direct, scope).alias("scope"),
        F.when(F.col("materialization") == "append", "fresh").otherwise(F.col("materialization")).alias("materialization"),
        F.when(seq != 1, F.col("sole_producer") == 1).alias("soleProducer"),
        F.when(~direct & (seq != 2), inputs).alias("inputs"),
    )
    arrived = e.attestations.select("att_id", F.base64(F.to_json(record).cast("binary")).alias("payload"))
    return A.envelope_shapes(arrived, "payload").select("att_id", "problem")
