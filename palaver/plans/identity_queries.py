"""Queries of vectors and speaker identity."""

from __future__ import annotations

from pyspark.sql import functions as F

from palaver.functions.scalars import band
from palaver.operators import identity as D
from palaver.operators.intervals import UNKNOWN
from palaver.plans.registry import literal_rows, query, table

VECTORS = "v AS (SELECT vec_id, label, generate_subscripts(embedding, 1) AS i, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings WHERE embedding IS NOT NULL), c AS (SELECT label, i, avg(x) AS m FROM v GROUP BY 1, 2)"
#: Bands for these vectors, whose best cosines are low.
LOW_BANDS = ((0.35, "confirmed"), (0.25, "probable"), (0.15, "candidate"))
SCORES = f"""{VECTORS}, n AS (SELECT label, sqrt(sum(m * m)) AS l FROM c GROUP BY 1), q AS (SELECT vec_id, sqrt(sum(x * x)) AS l FROM v GROUP BY 1),
s AS (SELECT v.vec_id, c.label, sum(v.x * c.m) / (any_value(q.l) * any_value(n.l)) AS score FROM v JOIN c ON v.i = c.i JOIN n ON n.label = c.label JOIN q ON q.vec_id = v.vec_id GROUP BY 1, 2)"""


def _centroids(spark, sf_dir):
    return D.centroids(table(spark, sf_dir, "embeddings"))


@query("centroids", f"WITH {VECTORS}, k AS (SELECT label, count(*) AS n FROM embeddings GROUP BY 1) SELECT c.label, CAST(i - 1 AS INTEGER) AS i, round(m, 6) AS m, n AS sample_count FROM c JOIN k ON c.label = k.label")
def centroids(spark, sf_dir):
    return _centroids(spark, sf_dir).select("label", "sample_count", F.posexplode("centroid").alias("i", "m")).withColumn("m", F.round("m", 6))


@query("best_match", f"WITH {SCORES} SELECT vec_id AS query_id, CASE WHEN score >= 0.2 THEN label END AS match_id, round(score, 6) AS score FROM s QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY round(score, 9) DESC, label) = 1")
def best_match(spark, sf_dir):
    known = _centroids(spark, sf_dir).select(F.col("label").alias("candidate_id"), F.col("label").alias("pos"), F.col("centroid").alias("embedding"))
    asked = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("query_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    return D.best_match(asked, known, 0.2).withColumn("score", F.round("score", 6))


@query("bands", f"""WITH {SCORES}, b AS (SELECT vec_id, max(round(score, 9)) AS s FROM s GROUP BY 1)
SELECT vec_id AS query_id, CASE WHEN s >= 0.92 THEN 'confirmed' WHEN s >= 0.8 THEN 'probable' WHEN s >= 0.6 THEN 'candidate' ELSE 'unknown' END AS band, CASE WHEN s >= 0.35 THEN 'confirmed' WHEN s >= 0.25 THEN 'probable' WHEN s >= 0.15 THEN 'candidate' ELSE 'unknown' END AS low_band FROM b""")
def bands(spark, sf_dir):
    known = _centroids(spark, sf_dir).select(F.col("label").alias("candidate_id"), F.col("label").alias("pos"), F.col("centroid").alias("embedding"))
    asked = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("query_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    return D.best_match(asked, known, 0.2).select("query_id", band(F.col("score")).alias("band"), band(F.col("score"), LOW_BANDS).alias("low_band"))


@query("greedy_assign", f"""WITH RECURSIVE {SCORES}, p AS (SELECT vec_id // 5 AS call_id, CAST(vec_id AS VARCHAR) AS label, CAST(label AS VARCHAR) AS name, round(score, 9) AS score FROM s WHERE round(score, 9) >= 0.1), o AS (SELECT *, row_number() OVER (PARTITION BY call_id ORDER BY score DESC, label, name) AS i FROM p),
g AS (SELECT call_id, i, label, name, score, [label] AS ls, [name] AS ns, true AS kept FROM o WHERE i = 1
UNION ALL SELECT o.call_id, o.i, o.label, o.name, o.score, CASE WHEN ok THEN list_append(ls, o.label) ELSE ls END, CASE WHEN ok THEN list_append(ns, o.name) ELSE ns END, ok FROM (SELECT g.call_id, g.i, ls, ns, o2.label AS nl, NOT list_contains(ls, o2.label) AND NOT list_contains(ns, o2.name) AS ok FROM g JOIN o o2 ON o2.call_id = g.call_id AND o2.i = g.i + 1) h JOIN o ON o.call_id = h.call_id AND o.i = h.i + 1)
SELECT call_id, label, name, round(score, 6) AS score FROM g WHERE kept""")
def greedy_assign(spark, sf_dir):
    """One-to-one pairs in groups of five vectors against all centroids."""
    known = _centroids(spark, sf_dir).select(F.col("label").alias("name"), F.col("label").alias("pos"), F.col("centroid").alias("embedding"))
    vectors = table(spark, sf_dir, "embeddings").select(F.floor(F.col("vec_id") / 5).alias("call_id"), F.col("vec_id").alias("label"), F.col("embedding").cast("array<double>").alias("embedding"))
    return D.greedy_assignment(D.all_scores(vectors, known, 0.1), 0.1).withColumn("score", F.round("score", 6))


def _identities(spark, sf_dir):
    """Customers as identities: calls and seconds out of their orders."""
    orders = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("total_calls"), F.sum("o_totalprice").alias("spent"))
    rows = table(spark, sf_dir, "customer").join(orders, "c_custkey")
    status = F.element_at(F.array(*map(F.lit, D.STATUS)), (F.col("c_custkey") % 4 + 1).cast("int"))
    return rows.select(
        F.concat(F.lit("spk_"), F.lpad(F.col("c_custkey").cast("string"), 8, "0")).alias("speaker_cluster_id"), F.when(F.col("c_custkey") % 4 == 3, F.col("c_name")).alias("canonical_name"), F.array().cast("array<string>").alias("aliases"),
        status.alias("status"), F.array(F.lit(1.0), F.lit(0.0)).alias("embedding_centroid"), F.col("total_calls").alias("sample_count"), F.lit("2026-01-01").alias("first_seen"), F.lit("2026-01-02").alias("last_seen"), "total_calls",
        (F.floor("spent") / 100).alias("total_speaking_seconds"), F.array().cast("array<string>").alias("typical_co_speakers"), F.lit("auto_cluster").alias("created_from"), F.lit("2026-01-02").alias("updated_at"),
    )


IDENTITIES = """i AS (SELECT 'spk_' || lpad(CAST(c_custkey AS VARCHAR), 8, '0') AS id, CASE WHEN c_custkey % 4 = 3 THEN c_name END AS name, ['unknown', 'candidate', 'probable', 'confirmed'][CAST(c_custkey % 4 + 1 AS INTEGER)] AS status, n, floor(s) / 100 AS secs
FROM customer JOIN (SELECT o_custkey AS k, count(*) AS n, sum(o_totalprice) AS s FROM orders GROUP BY 1) ON k = c_custkey)"""


@query("identity_list", f"WITH {IDENTITIES} SELECT id AS speaker_cluster_id, coalesce(name, id) AS display_name, status, n AS total_calls, secs AS total_speaking_seconds, 'spk_a,spk_b,spk_c,spk_d,spk_e' AS co_speakers FROM i")
def identity_list(spark, sf_dir):
    people = _identities(spark, sf_dir).withColumn("typical_co_speakers", F.array(*[F.lit(f"spk_{c}") for c in "abcdefg"]))
    return D.identity_list(people).withColumn("co_speakers", F.array_join("co_speakers", ","))


@query("identity_counts", f"WITH {IDENTITIES} SELECT count(*) AS total, count(*) FILTER (status = 'confirmed') AS confirmed, count(*) FILTER (status = 'unknown') AS unknown FROM i")
def identity_counts(spark, sf_dir):
    return D.identity_counts(_identities(spark, sf_dir))


@query("review_queue", f"""WITH {IDENTITIES} SELECT id AS speaker_cluster_id, round(0.35::DOUBLE * least(1.0, secs / 60 / 120) + 0.25::DOUBLE * least(1.0, n / 20) + 0.1::DOUBLE + 0.2::DOUBLE * least(1.0, n / 10), 3) AS priority,
CASE WHEN n >= 5 THEN 'frequent_unknown_speaker' WHEN secs >= 600 THEN 'high_speaking_time' ELSE 'new_unknown_speaker' END AS reason, n AS total_calls, secs AS total_speaking_seconds
FROM i WHERE status IN ('unknown', 'candidate') AND n >= 2 ORDER BY priority DESC, id LIMIT 20""")
def review_queue(spark, sf_dir):
    return D.review_queue(_identities(spark, sf_dir), 2)


@query("review_summary", f"""WITH {IDENTITIES} SELECT id AS speaker_cluster_id, round_even(secs / 60, 1) AS minutes, '2026-01-02' AS last_seen, 'Unknown speaker in ' || n || ' call(s). ' || printf('%.1f', round_even(secs / 60, 1)) || ' min total. co-speakers: x, y, z' AS summary FROM i WHERE status IN ('unknown', 'candidate') AND n >= 2
ORDER BY round(0.35::DOUBLE * least(1.0, secs / 60 / 120) + 0.25::DOUBLE * least(1.0, n / 20) + 0.1::DOUBLE + 0.2::DOUBLE * least(1.0, n / 10), 3) DESC, id LIMIT 20""")
def review_summary(spark, sf_dir):
    people = _identities(spark, sf_dir).withColumn("typical_co_speakers", F.array(*map(F.lit, "xyzq")))
    return D.review_summary(D.review_queue(people, 2), people).select("speaker_cluster_id", "minutes", "last_seen", "summary")


@query("confirmed_speakers", f"WITH {IDENTITIES} SELECT id AS speaker_cluster_id, name, n AS calls, round_even(secs / 60, 1) AS minutes FROM i WHERE status = 'confirmed'")
def confirmed_speakers(spark, sf_dir):
    return D.confirmed_speakers(_identities(spark, sf_dir))


@query("record_occurrences", f"WITH {IDENTITIES} SELECT id AS speaker_cluster_id, n + CASE WHEN n % 2 = 0 THEN n ELSE 0 END AS total_calls, round(secs + CASE WHEN n % 2 = 0 THEN n * 1.5::DOUBLE ELSE 0 END, 6) AS total_speaking_seconds, CASE WHEN n % 2 = 0 THEN '2026-03-01' ELSE '2026-01-02' END AS last_seen FROM i")
def record_occurrences(spark, sf_dir):
    people = _identities(spark, sf_dir)
    calls = people.filter("total_calls % 2 = 0").select("speaker_cluster_id", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("total_calls"))).alias("call_id"), F.lit(1.5).alias("total_speaking_seconds"))
    return D.record_occurrences(people, calls, "2026-03-01").select("speaker_cluster_id", "total_calls", F.round("total_speaking_seconds", 6).alias("total_speaking_seconds"), "last_seen")


@query("model_speakers", "SELECT c_custkey AS call_id, c_name AS name, CASE WHEN c_custkey % 3 = 0 THEN 'S0' WHEN c_custkey % 3 = 1 THEN 'spk_' || c_custkey ELSE 'S9' END AS label, CASE WHEN c_custkey % 3 < 2 THEN 'spk_' || c_custkey END AS speaker_cluster_id FROM customer")
def model_speakers(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("call_id"), F.col("c_name").alias("name"), F.concat(F.lit("spk_"), F.col("c_custkey").cast("string")).alias("speaker_cluster_id"))
    label = F.when(F.col("call_id") % 3 == 0, "S0").when(F.col("call_id") % 3 == 1, F.col("speaker_cluster_id")).otherwise("S9")
    return D.model_speakers(rows.select("call_id", "name", label.alias("label")), rows.select("call_id", F.lit("S0").alias("local_label"), "speaker_cluster_id"))


@query("match_status", "SELECT o_orderkey AS k, CASE WHEN o_orderkey % 2 = 0 THEN CASE WHEN o_orderkey % 101 / 100 >= 0.92 THEN 'confirmed' ELSE 'probable' END WHEN o_orderkey % 101 / 100 >= 0.92 THEN 'confirmed' WHEN o_orderkey % 101 / 100 >= 0.8 THEN 'probable' WHEN o_orderkey % 101 / 100 >= 0.6 THEN 'candidate' ELSE 'unknown' END AS status FROM orders")
def match_status(spark, sf_dir):
    k = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select(k.alias("k"), D.match_status(k % 101 / 100, F.when(k % 2 == 0, "confirmed").otherwise("unknown")).alias("status"))


@query("split_report", "SELECT 'spk_7' AS speaker_cluster_id, l_orderkey AS call_id, l_linenumber FROM lineitem WHERE l_suppkey = 7")
def split_report(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("call_id"), "l_linenumber", F.concat(F.lit("spk_"), F.col("l_suppkey").cast("string")).alias("speaker_cluster_id"))
    people = literal_rows(spark, [("spk_7", "unknown"), ("spk_8", "unknown")], "speaker_cluster_id string, status string")
    return D.split_report(people, rows, "spk_7").select("speaker_cluster_id", "call_id", "l_linenumber")


@query("migrate_v1", f"WITH {VECTORS}, k AS (SELECT label, count(*) AS n FROM embeddings GROUP BY 1) SELECT 'spk_' || left(sha256('v' || c.label), 8) AS speaker_cluster_id, 'v' || c.label AS canonical_name, 'confirmed' AS status, any_value(k.n) AS sample_count, round(sum(m), 6) AS total FROM c JOIN k ON c.label = k.label GROUP BY c.label")
def migrate_v1(spark, sf_dir):
    old = _centroids(spark, sf_dir).select(F.concat(F.lit("v"), F.col("label").cast("string")).alias("name"), F.col("centroid").alias("embedding"), F.col("sample_count").alias("num_samples"))
    total = F.aggregate("embedding_centroid", F.lit(0.0), lambda s, x: s + x)
    return D.migrate_v1(old, "2026-01-01").select("speaker_cluster_id", "canonical_name", "status", "sample_count", F.round(total, 6).alias("total"))


@query("remove_names", "SELECT DISTINCT 'v' || label AS name FROM embeddings WHERE label % 2 = 0")
def remove_names(spark, sf_dir):
    known = table(spark, sf_dir, "embeddings").select(F.concat(F.lit("v"), F.col("label").cast("string")).alias("name"), "label").distinct()
    return D.remove_names(known, known.filter("label % 2 = 1")).select("name")


@query("cospeakers", "WITH p AS (SELECT DISTINCT l_orderkey AS k, l_suppkey AS s FROM lineitem) SELECT a.s AS speaker_cluster_id, count(DISTINCT b.s) AS others, min(b.s) AS first_other FROM p a JOIN p b ON a.k = b.k AND a.s <> b.s GROUP BY 1")
def cospeakers(spark, sf_dir):
    found = D.co_speakers(table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("call_id"), F.col("l_suppkey").alias("speaker_cluster_id")))
    return found.select("speaker_cluster_id", F.size("co_speakers").cast("bigint").alias("others"), F.get("co_speakers", F.lit(0)).alias("first_other"))


@query("cluster_merge", f"""WITH {VECTORS}, k AS (SELECT label, count(*) AS n FROM embeddings GROUP BY 1), t AS (SELECT label, CASE WHEN label IN (1, 2) THEN 0 ELSE label END AS g FROM k), m AS (SELECT g, i, sum(m * n) / sum(n) AS m FROM c JOIN k USING (label) JOIN t USING (label) WHERE g <> 3 GROUP BY 1, 2),
w AS (SELECT g, CAST(sum(n) AS BIGINT) AS n, count(*) AS calls, CAST(min(label) AS VARCHAR) AS first_seen, max(CAST(label AS VARCHAR)) AS last_seen, coalesce(string_agg('name ' || label, ',' ORDER BY 'name ' || label) FILTER (label <> g AND label % 2 = 0), '') AS aliases FROM k JOIN t USING (label) GROUP BY 1)
SELECT 'spk_' || w.g AS speaker_cluster_id, CASE WHEN w.g % 2 = 0 THEN 'name ' || w.g END AS canonical_name, CASE WHEN w.g % 4 = 1 THEN 'confirmed' ELSE 'candidate' END AS status, w.n AS sample_count, first_seen, last_seen, calls AS total_calls, aliases, CASE WHEN w.g = 0 THEN '' ELSE 'spk_0' END AS co_speakers, round(sum(m.m), 6) AS total
FROM w LEFT JOIN m ON m.g = w.g GROUP BY ALL""")
def cluster_merge(spark, sf_dir):
    """Clusters 2 into 1 and 1 into 0, and one into nobody, which does nothing; cluster 3 has no centroid."""
    label = F.col("label")
    rows = _centroids(spark, sf_dir).select(
        F.concat(F.lit("spk_"), label.cast("string")).alias("speaker_cluster_id"), F.when(label % 2 == 0, F.concat(F.lit("name "), label.cast("string"))).alias("canonical_name"), F.array().cast("array<string>").alias("aliases"), F.when(label % 4 == 1, "confirmed").otherwise("candidate").alias("status"),
        F.when(label != 3, F.col("centroid")).alias("embedding_centroid"), "sample_count", label.cast("string").alias("first_seen"), label.cast("string").alias("last_seen"), F.lit(1).cast("bigint").alias("total_calls"), F.lit(1.0).alias("total_speaking_seconds"),
        F.array(F.lit("spk_1")).alias("typical_co_speakers"), F.lit("c").alias("created_from"), F.lit("d").alias("updated_at"),
    )
    merged = D.merge_clusters(rows, literal_rows(spark, [("spk_1", "spk_0"), ("spk_2", "spk_1"), ("spk_3", "nobody")], "source string, target string"))
    total = F.aggregate("embedding_centroid", F.lit(0.0), lambda s, x: s + x)
    return merged.select("speaker_cluster_id", "canonical_name", "status", "sample_count", "first_seen", "last_seen", "total_calls", F.array_join("aliases", ",").alias("aliases"), F.array_join("typical_co_speakers", ",").alias("co_speakers"), F.round(total, 6).alias("total"))


@query("resolver")
def resolver(spark, sf_dir):
    """Vectors in groups of five as calls of their label's tenant, resolved in order; a stateful fold, so rows only (tests have a plain version)."""
    vectors = table(spark, sf_dir, "embeddings")
    speakers = vectors.select(F.floor(F.col("vec_id") / 5).alias("call_id"), F.floor(F.col("vec_id") / 5).alias("call_order"), (F.col("vec_id") % 5).cast("string").alias("local_label"), "embedding", (F.col("vec_id") % 7).cast("double").alias("speaking_seconds"), F.col("label").alias("tenant"))
    return D.resolve_calls(speakers, 0.3, "tenant")


@query("aggregate_confidence", """WITH r AS (SELECT o_orderkey AS k, o_orderkey % 100 / 100 AS e, CASE WHEN o_orderkey % 3 = 0 THEN 0.9::DOUBLE END AS c, CASE WHEN o_orderkey % 2 = 0 THEN 0.7::DOUBLE END AS h, CASE WHEN o_orderkey % 5 < 3 THEN 'db_match' ELSE 'auto_cluster' END AS src, CASE WHEN o_orderkey % 7 = 0 THEN 'confirmed' WHEN o_orderkey % 7 = 1 THEN 'probable' ELSE 'unknown' END AS st FROM orders),
t AS (SELECT *, round(CASE WHEN src = 'db_match' THEN 0.5::DOUBLE * e ELSE 0 END + 0.3::DOUBLE * coalesce(c, 0) + 0.2::DOUBLE * coalesce(h, 0), 9) AS x FROM r), u AS (SELECT *, st <> 'confirmed' AND x > e AS better, CASE WHEN x >= 0.92 THEN 'confirmed' WHEN x >= 0.8 THEN 'probable' WHEN x >= 0.6 THEN 'candidate' ELSE 'unknown' END AS b FROM t),
v AS (SELECT *, better AND list_position(['unknown', 'candidate', 'probable', 'confirmed'], b) > list_position(['unknown', 'candidate', 'probable', 'confirmed'], st) AS rises FROM u)
SELECT k, round(CASE WHEN better THEN x ELSE e END, 6) AS confidence, CASE WHEN rises THEN b ELSE st END AS status, CASE WHEN rises THEN 'aggregate' ELSE src END AS source FROM v""")
def aggregate_confidence(spark, sf_dir):
    k = F.col("o_orderkey")
    rows = table(spark, sf_dir, "orders").select(
        k.alias("k"), (k % 100 / 100).alias("confidence"), F.when(k % 3 == 0, 0.9).alias("calendar_score"), F.when(k % 2 == 0, 0.7).alias("hint_score"), F.when(k % 5 < 3, "db_match").otherwise("auto_cluster").alias("source"), F.when(k % 7 == 0, "confirmed").when(k % 7 == 1, "probable").otherwise("unknown").alias("status")
    )
    return D.aggregate_confidence(rows).select("k", F.round("confidence", 6).alias("confidence"), "status", "source")


@query("name_stages", """WITH r AS (SELECT o_orderkey AS call_id, CASE WHEN o_orderkey % 3 = 0 THEN 'confirmed' ELSE 'unknown' END AS status, o_orderkey % 2 = 0 AS cal, o_orderkey % 5 = 0 AS hint FROM orders)
SELECT call_id, CASE WHEN cal AND status = 'unknown' THEN 0.5::DOUBLE ELSE 0.0::DOUBLE END AS calendar_score, CASE WHEN hint THEN 0.7::DOUBLE ELSE 0.0::DOUBLE END AS hint_score, concat_ws(',', CASE WHEN cal AND status = 'unknown' THEN 'Runa:calendar_attendee,Bela:calendar_attendee' END, CASE WHEN hint THEN 'Quinn:transcript_self_intro' END) AS names FROM r""")
def name_stages(spark, sf_dir):
    calls = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("call_id"), F.lit("S0").alias("local_label"), F.when(F.col("o_orderkey") % 3 == 0, "confirmed").otherwise("unknown").alias("status"))
    people = calls.filter("call_id % 2 = 0").select("call_id", F.posexplode(F.array(F.lit("Runa"), F.lit("Bela"))).alias("pos", "name"), F.lit(0.5).alias("score"))
    hints = calls.filter("call_id % 5 = 0").select("call_id", F.lit("Quinn").alias("name"), F.lit(0.7).alias("confidence"), F.lit("self_intro").alias("pattern"), F.lit(0).alias("pos"), F.lit("S0").alias("target"))
    other = hints.withColumns({"name": F.lit("Noor"), "target": F.lit("addressed_by_S0")})
    names = F.array_join(F.transform("candidate_names", lambda c: F.concat(c["name"], F.lit(":"), c["source"])), ",")
    return D.name_stages(calls, people, hints.unionByName(other)).select("call_id", "calendar_score", "hint_score", names.alias("names"))


@query("update_co_speakers", "WITH p AS (SELECT DISTINCT l_orderkey AS k, 'spk_' || l_suppkey AS s FROM lineitem), o AS (SELECT a.s, b.s AS other FROM p a JOIN p b ON a.k = b.k AND a.s <> b.s UNION SELECT 'spk_' || s_suppkey, 'old' FROM supplier) SELECT s AS speaker_cluster_id, count(*) AS others, min(other) AS first_other FROM o WHERE s IN (SELECT 'spk_' || s_suppkey FROM supplier) GROUP BY 1")
def update_co_speakers(spark, sf_dir):
    people = table(spark, sf_dir, "supplier").select(F.concat(F.lit("spk_"), F.col("s_suppkey").cast("string")).alias("speaker_cluster_id"), F.array(F.lit("old")).alias("typical_co_speakers"))
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("call_id"), F.concat(F.lit("spk_"), F.col("l_suppkey").cast("string")).alias("speaker_cluster_id"))
    return D.update_co_speakers(people, rows).select("speaker_cluster_id", F.size("typical_co_speakers").cast("bigint").alias("others"), F.array_min("typical_co_speakers").alias("first_other"))


@query("apply_agreement", """WITH a AS (SELECT o_custkey AS k, max(n) AS n FROM (SELECT o_custkey, o_orderpriority, count(*) AS n FROM orders GROUP BY 1, 2) GROUP BY 1)
SELECT c_custkey AS speaker_cluster_id, CASE WHEN n >= 3 THEN 'confirmed' WHEN c_custkey % 2 = 0 OR n >= 2 THEN 'probable' WHEN n >= 1 THEN 'candidate' ELSE 'unknown' END AS status FROM customer LEFT JOIN a ON k = c_custkey""")
def apply_agreement(spark, sf_dir):
    people = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("speaker_cluster_id"), F.when(F.col("c_custkey") % 2 == 0, "probable").otherwise("unknown").alias("status"))
    return D.apply_agreement(people, table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("speaker_cluster_id"), F.col("o_orderpriority").alias("name")))


@query("agreement_status", "WITH a AS (SELECT o_custkey AS k, lower(o_orderpriority) AS p, count(*) AS n, min(o_orderpriority) AS name FROM orders GROUP BY 1, 2) SELECT k AS speaker_cluster_id, name, n AS agreements, CASE WHEN n >= 3 THEN 'confirmed' WHEN n >= 2 THEN 'probable' ELSE 'candidate' END AS status FROM a")
def agreement_status(spark, sf_dir):
    return D.agreement_status(table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("speaker_cluster_id"), F.col("o_orderpriority").alias("name")))


@query("confirm_identity", f"WITH {IDENTITIES} SELECT id AS speaker_cluster_id, CASE WHEN n % 5 = 0 THEN 'Runa' ELSE name END AS canonical_name, CASE WHEN n % 5 = 0 THEN 'confirmed' ELSE status END AS status, CASE WHEN n % 5 = 0 AND name IS NOT NULL THEN name ELSE '' END AS aliases, CASE WHEN n % 5 = 0 THEN '2026-02-01' ELSE '2026-01-02' END AS updated_at FROM i")
def confirm_identity(spark, sf_dir):
    people = _identities(spark, sf_dir)
    names = people.filter("total_calls % 5 = 0").select("speaker_cluster_id", F.lit("Runa").alias("name"))
    return D.confirm(people, names, "2026-02-01").select("speaker_cluster_id", "canonical_name", "status", F.array_join("aliases", ",").alias("aliases"), "updated_at")


@query("label_map", f"SELECT s_suppkey AS pos, coalesce(n_name, s_nationkey::VARCHAR) AS speaker, CASE WHEN n_name IS NOT NULL THEN 'spk_' || s_nationkey END AS speaker_cluster_id FROM supplier LEFT JOIN (SELECT * FROM nation WHERE n_regionkey <> 2) ON s_nationkey = n_nationkey WHERE '{UNKNOWN}' <> ''")
def label_map(spark, sf_dir):
    segments = table(spark, sf_dir, "supplier").select(F.lit(1).alias("call_id"), F.col("s_suppkey").alias("pos"), F.col("s_nationkey").cast("string").alias("speaker"))
    known = table(spark, sf_dir, "nation").filter("n_regionkey <> 2")
    resolved = known.select(F.lit(1).alias("call_id"), F.col("n_nationkey").cast("string").alias("local_label"), F.concat(F.lit("spk_"), F.col("n_nationkey").cast("string")).alias("speaker_cluster_id"), F.col("n_name").alias("display_name"), F.lit(1.0).alias("confidence"))
    return D.label_segments(segments, resolved).select("pos", "speaker", "speaker_cluster_id")


@query("enroll", f"""WITH {IDENTITIES}, f AS (SELECT min(id) AS id FROM i) SELECT i.id AS speaker_cluster_id, CASE WHEN i.id = f.id THEN 'Runa' ELSE name END AS canonical_name, CASE WHEN i.id = f.id THEN 'confirmed' ELSE status END AS status, n AS sample_count, secs AS total_speaking_seconds, 'auto_cluster' AS created_from FROM i, f
UNION ALL SELECT 'spk_' || left(sha256('2:S0'), 8), 'Bela', 'confirmed', 1, 9.0, 'enrollment'""")
def enroll(spark, sf_dir):
    people = _identities(spark, sf_dir)
    recordings = literal_rows(spark, [(1, "Runa", "S0", [2.0, 0.0], 60.0), (1, "Runa", "S1", [0.0, 1.0], 5.0), (2, "Bela", "S0", [0.0, 3.0], 9.0)], "call_id bigint, name string, local_label string, embedding array<double>, speaking_seconds double")
    return D.enroll(people, recordings, "2026-02-01").select("speaker_cluster_id", "canonical_name", "status", "sample_count", "total_speaking_seconds", "created_from")


@query("occurrence_filter", "SELECT l_orderkey AS call_id, l_linenumber FROM lineitem WHERE l_suppkey = 7")
def occurrence_filter(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("call_id"), "l_linenumber", F.col("l_suppkey").cast("string").alias("speaker_cluster_id"))
    return D.occurrences_of(rows, "7").select("call_id", "l_linenumber")


@query("unknown_speakers", f"WITH {IDENTITIES} SELECT id AS speaker_cluster_id FROM i WHERE status IN ('unknown', 'candidate') AND n >= 3")
def unknown_speakers(spark, sf_dir):
    return D.unknown_speakers(_identities(spark, sf_dir), 3).select("speaker_cluster_id")


@query("add_samples", f"WITH {VECTORS}, k AS (SELECT label, count(*) AS n FROM embeddings GROUP BY 1) SELECT CAST(c.label AS VARCHAR) AS name, CAST(i - 1 AS INTEGER) AS i, round((m * n + 1.0::DOUBLE) / (n + 1), 6) AS m, n + 1 AS num_samples FROM c JOIN k ON c.label = k.label")
def add_samples(spark, sf_dir):
    old = _centroids(spark, sf_dir).select(F.col("label").cast("string").alias("name"), F.col("centroid").alias("embedding"), F.col("sample_count").alias("num_samples"))
    after = D.add_samples(old, old.select("name", F.transform("embedding", lambda _: F.lit(1.0)).alias("embedding")))
    return after.select("name", "num_samples", F.posexplode("embedding").alias("i", "m")).withColumn("m", F.round("m", 6))
