"""One query for each operator, over its whole table with the operator's production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import ann, centroids, decontam, importance, jaccard, langid, lines, packing, recompress, simhash, suffixes, toxicity, urls
from tidemark.llm.common import held_out
from tidemark.llm.registry import query, table

#: The rules every url is judged by.
URL_RULES = (
    ("allow", "com/"),
    ("block", "example.com/en/"),
    ("allow", "www.example.com/en/"),
    ("block", "net/es/"),
    ("block", "net/fr/"),
)


@query("op1_simhash_near_dedup")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_dedup_groups(table(spark, sf_dir, "documents"), width=4, bits=64, radius=4)
    return found.select("doc_id", F.lower(F.lpad(F.hex(F.col("fp")[0]), 16, "0")).alias("fingerprint"), "component_id")


def url_oracle() -> str:
    rules = ", ".join(f"('{verdict}', '{p.partition('/')[0]}', '/{p.partition('/')[2]}', '{p}')" for verdict, p in URL_RULES)
    terms = ", ".join(f"('{t}', {w})" for w, ts in ((2, urls.STRICT), (1, urls.SOFT)) for t in ts)
    lower = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return f"""
    WITH rules(said, site, start, rule) AS (VALUES {rules}), terms(term, weight) AS (VALUES {terms}),
    parts AS (
        SELECT page_id, url, {lower.format("coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), '')")} AS host,
            coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path
        FROM pages),
    fit AS (
        SELECT page_id, max_by(rule, length(rule)) AS rule, max_by(said, length(rule)) AS said
        FROM parts JOIN rules ON (host = site OR ends_with(host, '.' || site)) AND starts_with(path, start)
        GROUP BY page_id),
    hits AS (
        SELECT page_id, CAST(count(*) FILTER (weight = 2) AS INTEGER) AS n_strict, CAST(count(*) FILTER (weight = 1) AS INTEGER) AS n_soft
        FROM parts JOIN terms ON regexp_matches({lower.format('url')}, '(^|[^a-z0-9])' || term || '($|[^a-z0-9])')
        GROUP BY page_id)
    SELECT page_id, host, path, rule,
        coalesce(said, CASE WHEN coalesce(n_strict, 0) >= 1 OR coalesce(n_soft, 0) >= {urls.SOFT_LIMIT} THEN 'block' ELSE 'allow' END) AS verdict,
        coalesce(n_strict, 0) AS n_strict, coalesce(n_soft, 0) AS n_soft
    FROM parts LEFT JOIN fit USING (page_id) LEFT JOIN hits USING (page_id)"""


@query("op2_url_filter", url_oracle())
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.url_verdicts(table(spark, sf_dir, "pages"), URL_RULES)


@query("op3_best_fit_packing")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def line_oracle(reach: int) -> str:
    return f"""
    WITH cut AS (SELECT doc_id, text, string_split(text, chr(10)) AS pieces FROM documents),
    listed AS (SELECT doc_id, unnest(pieces) AS line, generate_subscripts(pieces, 1) - 1 AS pos FROM cut),
    filled AS (
        SELECT doc_id, trim(line) AS line, pos, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS rank
        FROM listed WHERE trim(line) <> ''),
    windows AS (
        SELECT doc_id, rank, pos AS a, lead(pos, {reach - 1}) OVER w AS b,
            {", ".join(f"lead(line, {i}) OVER w AS l{i}" for i in range(reach))}
        FROM filled WINDOW w AS (PARTITION BY doc_id ORDER BY rank)),
    later AS (
        SELECT doc_id, rank, a, b FROM (
            SELECT *, row_number() OVER (PARTITION BY {", ".join(f"l{i}" for i in range(reach))} ORDER BY doc_id, rank) AS nth
            FROM windows WHERE b IS NOT NULL)
        WHERE nth > 1),
    broken AS (
        SELECT *, CASE WHEN rank - lag(rank) OVER (PARTITION BY doc_id ORDER BY rank) <= {reach} THEN 0 ELSE 1 END AS new FROM later),
    runs AS (
        SELECT doc_id, run, min(a) AS a, max(b) AS b
        FROM (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY rank) AS run FROM broken) GROUP BY doc_id, run),
    gone AS (SELECT DISTINCT listed.doc_id, pos FROM listed JOIN runs ON runs.doc_id = listed.doc_id AND pos BETWEEN a AND b),
    kept AS (
        SELECT listed.doc_id, string_agg(line, chr(10) ORDER BY listed.pos) AS text
        FROM listed LEFT JOIN gone ON gone.doc_id = listed.doc_id AND gone.pos = listed.pos
        WHERE gone.doc_id IS NULL GROUP BY listed.doc_id)
    SELECT cut.doc_id, CAST(coalesce(len(pieces), 0) AS BIGINT) AS n_lines,
        (SELECT count(*) FROM gone WHERE gone.doc_id = cut.doc_id) AS n_removed,
        sha256(coalesce(kept.text, '')) AS kept_sha256
    FROM cut LEFT JOIN kept ON kept.doc_id = cut.doc_id"""


@query("op4_line_dedup", line_oracle(lines.GRAM + lines.WINDOW - 1))
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = lines.line_dedup(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))


@query("op5_nearest_neighbours")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    return ann.nearest(rows, rows.filter("vec_id % 20 = 0"), k=20)


def word_oracle(window: int) -> str:
    return f"""
    WITH words AS (
        SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') AS ws FROM documents),
    windows AS (
        SELECT doc_id, s, md5(array_to_string(ws[s:s + {window - 1}], ' ')) AS whole
        FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - {window - 2})) AS s FROM words)),
    twice AS (SELECT whole FROM windows GROUP BY whole HAVING count(*) > 1),
    gone AS (
        SELECT doc_id, list(DISTINCT pos) AS poss
        FROM (SELECT doc_id, unnest(range(s, s + {window})) AS pos FROM windows JOIN twice USING (whole)) GROUP BY doc_id),
    listed AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS pos FROM words),
    marked AS (SELECT doc_id, unnest(poss) AS pos FROM gone),
    kept AS (
        SELECT listed.doc_id, string_agg(word, ' ' ORDER BY listed.pos) AS text
        FROM listed LEFT JOIN marked ON marked.doc_id = listed.doc_id AND marked.pos = listed.pos
        WHERE marked.doc_id IS NULL GROUP BY listed.doc_id)
    SELECT words.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(len(poss), 0) AS BIGINT) AS n_removed,
        sha256(coalesce(kept.text, '')) AS kept_sha256
    FROM words LEFT JOIN gone ON gone.doc_id = words.doc_id LEFT JOIN kept ON kept.doc_id = words.doc_id"""


@query("op6_substring_dedup", word_oracle(recompress.WINDOW))
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = recompress.substring_dedup(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_removed", "kept_sha256")


@query("op7_benchmark_decontamination")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op8_toxicity")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


@query("op9_language_id")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = langid.identify(docs, langid.fit(docs))
    return found.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "lang_pred", "score", "n_words")


def byte_oracle(length: int) -> str:
    return f"""
    WITH texts AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS t FROM documents),
    windows AS (
        SELECT doc_id, s, md5(substr(t, 2 * s + 1, {2 * length})) AS whole
        FROM (SELECT doc_id, t, unnest(range(0, CAST(length(t) / 2 AS BIGINT) - {length - 1})) AS s FROM texts)),
    firsts AS (SELECT whole, min((doc_id, s)) AS first FROM windows GROUP BY whole HAVING count(*) > 1),
    later AS (SELECT doc_id, s FROM windows JOIN firsts USING (whole) WHERE (doc_id, s) <> first),
    broken AS (SELECT *, CASE WHEN s - lag(s) OVER (PARTITION BY doc_id ORDER BY s) <= {length} THEN 0 ELSE 1 END AS new FROM later),
    runs AS (
        SELECT doc_id, min(s) AS a, max(s) + {length} AS b
        FROM (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY s) AS run FROM broken) GROUP BY doc_id, run),
    edges AS (SELECT *, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS since FROM runs),
    cut AS (
        SELECT doc_id, string_agg(substr(t, 2 * since + 1, 2 * (a - since)), '' ORDER BY a) AS head, max(b) AS last,
            sum(b - a) AS n_removed, count(*) AS n_spans
        FROM edges JOIN texts USING (doc_id) GROUP BY doc_id)
    SELECT texts.doc_id, CAST(length(t) / 2 AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed,
        CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans,
        sha256(unhex(coalesce(head || substr(t, 2 * last + 1), t))) AS kept_sha256
    FROM texts LEFT JOIN cut USING (doc_id)"""


@query("op10_suffix_array_dedup", byte_oracle(suffixes.LENGTH))
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffixes.suffix_dedup(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def gain_oracle(grams: int, buckets: int, percent: int, least: int, seed: int) -> str:
    lower = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    words = f"regexp_extract_all({lower}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
    runs = " UNION ALL ".join(
        f"SELECT own, doc_id, unnest(list_transform(range(1, len(ws) - {n - 2}), lambda i: array_to_string(ws[i:i + {n - 1}], ' '))) AS feature FROM texts"
        for n in range(1, grams + 1)
    )
    step = "CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END"
    return f"""
    WITH crc AS (
        SELECT list(list_reduce(range(8), lambda c, k: {step}, i) ORDER BY i) AS steps FROM (SELECT unnest(range(256)) AS i)),
    texts AS (
        SELECT 1 AS own, doc_id, {words} AS ws FROM documents UNION ALL SELECT 0, item_id, {words} FROM benchmark),
    listed AS ({runs}),
    bytes AS (SELECT feature, hex(encode(feature)) AS h FROM (SELECT DISTINCT feature FROM listed)),
    hashed AS (
        SELECT feature, xor(list_reduce(
            list_transform(range(0, CAST(length(h) / 2 AS BIGINT)), lambda i: CAST('0x' || substr(h, 2 * i + 1, 2) AS BIGINT)),
            lambda c, b: xor(c >> 8, steps[xor(c, b) % 256 + 1]), 4294967295), 4294967295) % {buckets} AS bucket
        FROM bytes, crc),
    placed AS (SELECT own, doc_id, bucket FROM listed JOIN hashed USING (feature)),
    counted AS (SELECT bucket, count(*) FILTER (own = 1) AS s, count(*) FILTER (own = 0) AS t FROM placed GROUP BY bucket),
    totals AS (SELECT CAST(count(*) FILTER (own = 1) AS DOUBLE) AS all_s, CAST(count(*) FILTER (own = 0) AS DOUBLE) AS all_t FROM placed),
    gains AS (
        SELECT bucket, CAST(floor(1000 * ln((CAST(t AS DOUBLE) + 1) * (all_s + {buckets}) / ((CAST(s AS DOUBLE) + 1) * (all_t + {buckets})))) AS BIGINT) AS gain
        FROM counted, totals),
    weighed AS (
        SELECT doc_id, count(*) AS n_features, CAST(floor(CAST(sum(gain) AS DOUBLE) / count(*)) AS BIGINT) AS weight
        FROM placed JOIN gains USING (bucket) WHERE own = 1 GROUP BY doc_id),
    scored AS (
        SELECT texts.doc_id, len(ws) AS n_words, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
            coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('{seed}:' || texts.doc_id), 1, 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296))) AS BIGINT) AS score
        FROM texts LEFT JOIN weighed ON weighed.doc_id = texts.doc_id WHERE own = 1),
    ranks AS (
        SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank, count(*) OVER () AS n FROM scored WHERE n_words >= {least})
    SELECT scored.doc_id, n_features, weight, score, CASE WHEN rank <= {percent} * n // 100 THEN rank END AS rank
    FROM scored LEFT JOIN ranks ON ranks.doc_id = scored.doc_id"""


@query("op11_importance_resampling", gain_oracle(2, importance.BUCKETS, 25, 20, 7))
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = importance.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_features", "weight", "score", "rank")


def centroid_oracle(clusters: int, rounds: int, size: int, scale: int, seed: int) -> str:
    nearest = """
    a{n} AS (
        SELECT vec_id, min({{'distance': distance, 'cluster': cluster}}) AS best
        FROM (SELECT vec_id, cluster, CAST(sum((x - c) * (x - c)) AS BIGINT) AS distance FROM listed JOIN c{n} USING (k) GROUP BY vec_id, cluster)
        GROUP BY vec_id)"""
    moved = """
    c{m} AS (
        SELECT cluster, k, coalesce(mean, c) AS c
        FROM c{n} LEFT JOIN (
            SELECT best.cluster AS cluster, k, CAST((sum(x) - (sum(x) % count(*) + count(*)) % count(*)) // count(*) AS BIGINT) AS mean
            FROM listed JOIN a{n} USING (vec_id) GROUP BY ALL) USING (cluster, k))"""
    steps = ",".join(nearest.format(n=n) + (("," + moved.format(n=n, m=n + 1)) if n < rounds else "") for n in range(rounds + 1))
    return f"""
    WITH kept AS (
        SELECT vec_id, list_transform(embedding, lambda x: CAST(floor({scale} * CAST(x AS DOUBLE)) AS BIGINT)) AS parts
        FROM embeddings WHERE vec_id IS NOT NULL AND len(embedding) = {size} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {size}),
    listed AS (SELECT vec_id, unnest(parts) AS x, generate_subscripts(parts, 1) AS k FROM kept),
    c0 AS (
        SELECT cluster, unnest(parts) AS c, generate_subscripts(parts, 1) AS k
        FROM (SELECT row_number() OVER (ORDER BY sha256('{seed}:' || vec_id), vec_id) - 1 AS cluster, parts FROM kept) WHERE cluster < {clusters}),
    {steps},
    summed AS (SELECT best.cluster AS cluster, CAST(sum(best.distance) AS BIGINT) AS cluster_inertia FROM a{rounds} GROUP BY ALL),
    digests AS (SELECT cluster, sha256(string_agg(CAST(c AS VARCHAR), ',' ORDER BY k)) AS centroid_sha256 FROM c{rounds} GROUP BY cluster)
    SELECT vec_id, CAST(best.cluster AS INTEGER) AS cluster, best.distance AS distance, cluster_inertia,
        (SELECT CAST(sum(cluster_inertia) AS BIGINT) FROM summed) AS inertia, centroid_sha256
    FROM a{rounds} JOIN summed ON summed.cluster = best.cluster JOIN digests ON digests.cluster = best.cluster"""


@query("op12_centroid_clustering", centroid_oracle(40, 5, 64, 256, 2))
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.with_inertia(*centroids.cluster_vectors(table(spark, sf_dir, "embeddings")))


def jaccard_oracle(width: int, percent: int) -> str:
    lower = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return f"""
    WITH RECURSIVE words AS (
        SELECT doc_id, list_filter(regexp_split_to_array({lower}, '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') AS ws FROM documents),
    sets AS (
        SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] ELSE list_distinct(list_transform(
            range(1, greatest(1, len(ws) - {width - 1}) + 1), lambda i: array_to_string(ws[i:i + {width - 1}], ' '))) END AS held
        FROM words),
    listed AS (SELECT doc_id, len(held) AS size, unnest(held) AS shingle FROM sets),
    pairs AS (
        SELECT a.doc_id AS a, b.doc_id AS b
        FROM listed a JOIN listed b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id AND 100 * a.size >= {percent} * b.size AND 100 * b.size >= {percent} * a.size
        GROUP BY a.doc_id, b.doc_id, a.size, b.size HAVING 100 * count(*) >= {percent} * (a.size + b.size - count(*))),
    reach AS (SELECT doc_id, doc_id AS other FROM sets UNION SELECT reach.doc_id, pairs.b FROM reach JOIN pairs ON pairs.a = reach.other)
    SELECT sets.doc_id, CAST(len(held) AS BIGINT) AS n_shingles, component_id
    FROM sets JOIN (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id) USING (doc_id)"""


@query("op13_ngram_jaccard_join", jaccard_oracle(5, 80))
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_components(table(spark, sf_dir, "documents"))
