"""Fingerprints, readers and bundles."""

from __future__ import annotations

import base64
import hashlib
import json

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.canon import number_text, row_repr
from tidemark.operators import admission as A
from tidemark.operators import coverage as V
from tidemark.operators import fingerprint as P
from tidemark.plans import marts as M
from tidemark.sources import bundle as U
from tidemark.sources import tables as R

ORDERS = "order_id LONG, customer STRING, order_total DOUBLE, order_date STRING"
ROWS = [(1, "Ada Lo", 10.5, "2026-01-01"), (2, 'Q "x"\n', 217.0, "2026-01-02"), (3, None, None, "2026-01-02")]


def prints(df, exclude=()):
    r = P.fingerprint(df, "t", exclude).first()
    return r.schema_fp, r.content_fp


def test_invariances(spark):
    base = spark.createDataFrame(ROWS, ORDERS)
    schema, content = prints(base)
    assert prints(spark.createDataFrame(ROWS[::-1], ORDERS)) == (schema, content)
    assert prints(base.repartition(3)) == (schema, content)
    renamed = prints(base.withColumnRenamed("order_total", "total"))
    assert renamed[0] != schema and renamed[1] == content
    edited = prints(base.withColumn("customer", F.upper("customer")))
    assert edited[0] == schema and edited[1] != content
    wider = prints(base.withColumn("extra", F.lit(1)))
    assert wider[0] != schema and wider[1] != content
    assert prints(base.union(base))[1] != content
    assert prints(base.limit(0))[1] != content
    loaded = base.withColumn("loaded_at", F.lit("mon"))
    later = base.withColumn("loaded_at", F.lit("tue"))
    assert prints(loaded, ("loaded_at",)) == prints(later, ("loaded_at",)) and prints(loaded) != prints(later)
    with pytest.raises(ValueError):
        P.content_fp(base, base.columns)


def test_numbers_equal_by_value_and_never_equal_strings(spark):
    whole, float_, word = (spark.sql(f"SELECT {x} AS v") for x in ("217L", "217.0D", "'217'"))
    assert prints(whole)[1] == prints(float_)[1] != prints(word)[1]
    big = spark.sql("SELECT 9007199254740993L AS v"), spark.sql("SELECT 9007199254740992L AS v")
    assert prints(big[0])[1] != prints(big[1])[1]
    assert prints(spark.sql("SELECT true AS v"))[1] != prints(spark.sql("SELECT 1 AS v"))[1]


@pytest.mark.parametrize("x", [0.0, 217.0, 1.5, 0.1, 1e-5, 2.5e-7, 12345678.9, 1e15 + 0.5, 1e22, -3.25, 0.00012])
def test_number_text_reads_as_json(spark, x):
    want = str(int(x)) if x == int(x) and abs(x) <= 2**53 else json.dumps(x)
    assert spark.range(1).select(number_text(F.lit(x))).first()[0] == want


def exact_digest(df) -> str:
    """SHA-256 over the sorted row texts joined by newlines, as recorded digests of small tables were made."""
    texts = sorted(r.s for r in df.select(row_repr(df, df.columns).alias("s")).collect())
    return hashlib.sha256("\n".join(texts).encode()).hexdigest()


def test_exact_mode_reproduces_recorded_digests(spark):
    # A recorded table and the digests recorded for it.
    rows = [
        ("2026-07-13", 392.38, 5, 78.476),
        ("2026-07-14", 924.38, 10, 92.438),
        ("2026-07-15", 577.62, 5, 115.524),
        ("2026-07-16", 1253.84, 12, 104.48666666666666),
        ("2026-07-17", 921.38, 7, 131.62571428571428),
    ]
    df = spark.createDataFrame(rows, "order_date STRING, total_revenue DOUBLE, order_count LONG, average_order_value DOUBLE")
    assert exact_digest(df) == "743933e56250798d370f835dd8ae4bfc40608b88fcd8498611d81d54db460531"
    assert P.fingerprint(df, "t").first().schema_fp == "e67a1da2bbcaa77efb95f7c30cfd667b89d31012dbb9ceb5d47a83a2b7cac5e3"


def test_row_text_escapes_as_json(spark):
    texts = ['a"b\\c', "tab\t nl\n", "\x01\x0b\x1f é", "\\u001F", None]
    df = spark.createDataFrame([(i, t, 1.0) for i, t in enumerate(texts)], "i LONG, t STRING, x DOUBLE")
    got = {r.i: r.s for r in df.select("i", row_repr(df, ["t", "x"]).alias("s")).collect()}
    for i, t in enumerate(texts):
        assert got[i] == json.dumps([t, 1], separators=(",", ":"), ensure_ascii=False)


def test_read_table(spark, tmp_path):
    (tmp_path / "t.json").write_text(json.dumps({"columns": ["a", "b"], "rows": [{"a": 1, "b": "x"}, {"a": 2}]}))
    (tmp_path / "bad.json").write_text(json.dumps({"rows": []}))
    row = T.StructType([T.StructField("b", T.StringType()), T.StructField("a", T.LongType())])
    df = R.read_table(spark, str(tmp_path / "t.json"), row)
    assert df.columns == ["a", "b"] and {tuple(r) for r in df.collect()} == {(1, "x"), (2, None)}
    with pytest.raises(R.NotATable):
        R.read_table(spark, str(tmp_path / "bad.json"), row)
    R.write_table(df, str(tmp_path / "out"))
    assert prints(spark.read.parquet(str(tmp_path / "out"))) == prints(df)


def test_read_zones(spark, tmp_path):
    (tmp_path / "z.csv").write_text("LocationID,Borough,Zone,service_zone\n1,EWR,Newark Airport,EWR\nx,Q,Z,S\n264,,,\n")
    got = {tuple(r) for r in R.read_zones(spark, str(tmp_path / "z.csv")).collect()}
    assert got == {(1, "Newark Airport", "EWR", "EWR"), (264, "", "", "")}


# -- bundles -----------------------------------------------------------------------------------

SEED, BUILT = "urn:li:dataset:(p,s.customers,PROD)", "urn:li:dataset:(p,s.details,PROD)"


def signed(n, **fields):
    record = {"request": "r1", "version": "v1", "attestor": "team", "at": f"2026-02-0{n}T00:00:00.000Z", "nonce": f"n{n}", **fields}
    payload = base64.b64encode(json.dumps(record).encode()).decode()
    envelope = {"payload": payload, "payloadType": "json", "signatures": [{"keyid": "k1", "sig": "00"}]}
    return {"asset": record["asset"], "sequence": 1, "at": record["at"], "body": {"keyId": "k1", "nonce": f"n{n}", "envelope": envelope}}


def bundle():
    direct = signed(1, kind="direct", asset=SEED, result="absent", scope={"kind": "whole"}, predicate={"identifiers": ["cust"], "expression": "id = 'cust'", "columns": ["id"]})
    rebuild = signed(2, kind="rebuild", asset=BUILT, materialization="full", soleProducer=True, inputs=[{"asset": SEED, "version": "v1"}])
    challenge = lambda n, a: {"nonce": f"n{n}", "request": "r1", "asset": a, "issuedAt": "2026-01-31T00:00:00.000Z", "expiresAt": "2026-03-01T00:00:00.000Z"}
    return {
        "formatVersion": 1,
        "request": {"request": "r1", "identifierDigests": [hashlib.sha256(b"cust").hexdigest()], "seeds": [SEED], "hops": 3},
        "reachable": [SEED, BUILT],
        "upstreamOf": {BUILT: [SEED], SEED: []},
        "keys": [{"keyId": "k1", "attestor": "team", "publicKeyPem": "pem", "notBefore": "2026-01-01T00:00:00.000Z", "status": {"state": "active"}, "scope": ["urn:*"]}],
        "challenges": [challenge(1, SEED), challenge(2, BUILT)],
        "attestations": [direct, rebuild],
        "report": {
            "coverage": [{"asset": a, "version": "v1", "state": "ATTESTED"} for a in (SEED, BUILT)],
            "summary": {"total": 2, "attested": 2, "unproven": 0, "contradicted": 0},
        },
    }


def tampered():
    out = {"sound": bundle()}
    for name in ("version", "compromised", "retired", "report", "filed"):
        out[name] = bundle()
    record = json.loads(base64.b64decode(out["version"]["attestations"][0]["body"]["envelope"]["payload"]))
    record["version"] = "v0"
    out["version"]["attestations"][0]["body"]["envelope"]["payload"] = base64.b64encode(json.dumps(record).encode()).decode()
    out["compromised"]["keys"][0]["status"] = {"state": "compromised", "at": "2026-02-05T00:00:00.000Z"}
    out["retired"]["keys"][0]["status"] = {"state": "retired", "at": "2026-02-05T00:00:00.000Z"}
    out["report"]["report"]["coverage"][1]["state"] = "UNPROVEN"
    out["filed"]["attestations"][0]["body"]["nonce"] = "other"
    return out


OUTCOMES = {
    "sound": {"same"},
    "version": {"version differs", "state differs"},
    "compromised": {"state differs"},
    "retired": {"same"},
    "report": {"same", "state differs"},
    "filed": {"same"},
}


@pytest.mark.parametrize("name", sorted(OUTCOMES))
def test_bundle_is_rederived_and_tampering_shows(spark, tmp_path, name):
    (tmp_path / "b.json").write_text(json.dumps(tampered()[name]))
    bundles = U.read_bundles(spark, str(tmp_path)).cache()
    assert bundles.first().problem is None
    signed = U.filed_records(bundles).select("att_id", F.lit(1).alias("signature_valid"))
    again = V.states(V.derive(U.bundle_evidence(bundles, signed)))
    got = {r.outcome for r in A.compare_reports(U.recorded_report(bundles), again).collect()}
    assert got == OUTCOMES[name]
    copied = A.copy_mismatches(U.filed_records(bundles)).collect()
    assert [r.problem for r in copied] == (["recorded-nonce-mismatch"] if name == "filed" else [])


def test_unsigned_bundle_record_counts_for_nothing(spark, tmp_path):
    (tmp_path / "b.json").write_text(json.dumps(bundle()))
    bundles = U.read_bundles(spark, str(tmp_path))
    assert {r.state for r in V.states(V.derive(U.bundle_evidence(bundles))).collect()} == {"UNPROVEN"}
    bad = U.filed_records(bundles).filter(F.col("filed_asset") == SEED).select("att_id", F.lit(0).alias("signature_valid"))
    good = U.filed_records(bundles).filter(F.col("filed_asset") != SEED).select("att_id", F.lit(1).alias("signature_valid"))
    got = {r.state for r in V.states(V.derive(U.bundle_evidence(bundles, bad.union(good)))).collect()}
    assert got == {"UNPROVEN"}


@pytest.mark.parametrize(
    ("drop", "problem"),
    [("formatVersion", "formatVersion is not 1"), ("keys", "keys is missing or is not an array"), ("report", "report is missing or is not an object")],
)
def test_non_bundles_are_named(spark, tmp_path, drop, problem):
    broken = bundle()
    del broken[drop]
    (tmp_path / "b.json").write_text(json.dumps(broken))
    assert U.read_bundles(spark, str(tmp_path)).first().problem == problem


@pytest.mark.parametrize(
    ("change", "problem"),
    [
        ({}, None),
        ({"kind": "other"}, "kind is neither direct nor rebuild"),
        ({"nonce": ""}, "missing required fields: nonce"),
        ({"result": "maybe"}, "result is neither absent nor present"),
        ({"predicate": {"identifiers": [], "expression": "e", "columns": []}}, "predicate names no identifiers"),
        ({"predicate": {"identifiers": ["a"], "expression": "", "columns": []}}, "predicate has no expression"),
        ({"scope": {"kind": "some"}}, "scope is neither whole nor partitions"),
        ({"scope": {"kind": "partitions", "covered": ["p"], "total": 0}}, "partition scope has no positive total"),
        ({"kind": "rebuild", "materialization": "fresh"}, "materialization is not one of full, merge, append, partition"),
        ({"kind": "rebuild", "materialization": "full"}, "soleProducer is not stated"),
        ({"kind": "rebuild", "materialization": "full", "soleProducer": True, "inputs": [{"asset": "a"}]}, "an input names no version"),
        ({"kind": "rebuild", "materialization": "full", "soleProducer": True, "inputs": []}, None),
        ({"kind": "rebuild", "materialization": "full", "soleProducer": True, "inputs": ["a"]}, "an input names no asset"),
        ({"kind": "rebuild", "materialization": "full", "soleProducer": True, "inputs": [{"asset": "a", "version": 3}]}, "an input names no version"),
        ({"kind": "rebuild", "materialization": "full", "soleProducer": "true", "inputs": []}, "soleProducer is not stated"),
        ({"asset": 7, "version": 1}, "missing required fields: asset, version"),
        ({"predicate": {"identifiers": ["a", 5], "expression": "e", "columns": []}}, "predicate names no identifiers"),
        ({"predicate": "id = 'a'"}, "no predicate object"),
        ({"scope": {"kind": "partitions", "covered": ["p"], "total": "9"}}, "partition scope has no positive total"),
        ({"scope": {"kind": "partitions", "covered": ["p"], "total": 9}}, None),
    ],
)
def test_record_shapes(spark, change, problem):
    base = {"kind": "direct", "request": "r", "asset": "a", "version": "v", "attestor": "t", "at": "x", "nonce": "n", "result": "absent",
            "predicate": {"identifiers": ["a"], "expression": "e", "columns": ["c"]}, "scope": {"kind": "whole"}} | change
    payload = base64.b64encode(json.dumps(base).encode()).decode()
    df = spark.createDataFrame([(payload,)], "payload STRING")
    assert A.envelope_shapes(df, "payload").first().problem == problem


def test_unreadable_payload(spark):
    df = spark.createDataFrame([("!!",), (base64.b64encode(b"[1]").decode(),)], "payload STRING")
    assert {r.problem is not None for r in A.envelope_shapes(df, "payload").collect()} == {True}


def test_envelopes_carry_one_signature_and_the_expected_type(spark):
    record = {"kind": "rebuild", "request": "r", "asset": "a", "version": "v", "attestor": "t", "at": "x", "nonce": "n",
              "materialization": "full", "soleProducer": True, "inputs": []}
    payload = base64.b64encode(json.dumps(record).encode()).decode()
    rows = [(1, "right", ["k"]), (2, "other", ["k"]), (3, "right", ["k", "l"]), (4, "right", []), (5, None, None)]
    df = spark.createDataFrame([(*row, payload) for row in rows], "n INT, type STRING, keys ARRAY<STRING>, payload STRING")
    got = {r.n: r.problem for r in A.envelope_shapes(df, "payload", "keys", "type", "right").collect()}
    one, kind = "exactly one signature is required", "payload type is not the expected one"
    assert got == {1: None, 2: kind, 3: one, 4: one, 5: kind}


def test_a_refused_submission_leaves_its_nonce_open(spark):
    """A mis-signed record may be sent again; only what follows an accepted one is a replay."""
    day = "2026-01-05"
    cols = "att_id STRING, request STRING, asset STRING, seq INT, nonce STRING, signed_key STRING, claimed_attestor STRING, said_request STRING, signature_valid INT, at STRING"
    row = lambda i, asset, seq, valid: (i, "r", asset, seq, "n1", "k", "t", "r", valid, day)
    sent = spark.createDataFrame([row("bad", "a", 1, 0), row("good", "a", 2, 1), row("again", "a", 3, 1), row("worse", "a", 4, 0), row("other", "b", 5, 1)], cols)
    keys = spark.createDataFrame([("k", "t", "2026-01-01", "active", None)], "key_id STRING, attestor STRING, not_before STRING, state STRING, state_at STRING")
    scopes = spark.createDataFrame([("k", "*")], "key_id STRING, scope STRING")
    asked = spark.createDataFrame([("n1", "r", "a", "2026-01-04", "2026-02-01", 0)], "nonce STRING, request STRING, asset STRING, issued_at STRING, expires_at STRING, consumed INT")
    got = {r.att_id: list(r.failures) for r in A.validate_attestations(sent, keys, scopes, asked, F.lit("2026-01-06")).collect()}
    assert got == {
        "bad": ["bad-signature"],
        "good": [],
        "again": ["challenge-replayed"],
        "worse": ["bad-signature", "challenge-replayed"],
        "other": ["challenge-mismatch"],
    }


def test_clean_orders_casing_and_dropped_rows(spark):
    raw = spark.createDataFrame(
        [(1, "  Ben   RUIZ ", 10.0, "2026-01-01 05:00:00"), (2, "x", None, "2026-01-01"), (3, "x", -1.0, "2026-01-01")], ORDERS
    )
    got = M.clean_orders(raw).collect()
    assert [(r.order_id, r.customer, str(r.order_date)) for r in got] == [(1, "Ben Ruiz", "2026-01-01")]


def test_decimals_fingerprint_by_value_and_structs_by_field(spark):
    from tidemark.functions.canon import cell_key

    row = spark.sql("SELECT 217.00BD AS a, 217BD AS b, 10.50BD AS c, 100BD AS d, struct(1 AS x, '1' AS y) AS s, struct('1' AS x, 1 AS y) AS t")
    kinds = {f.name: f.dataType for f in row.schema}
    got = row.select(*[cell_key(F.col(n), k).alias(n) for n, k in kinds.items()]).first()
    assert (got.a, got.b, got.c, got.d) == ("217", "217", "10.5", "100") and got.s != got.t
