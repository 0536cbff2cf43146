"""Speaker identity over calls: matching of voice vectors, centroids, assignment, resolution, merging and review.

identities: see ``schemas.IDENTITY``; speakers: (call_id, local_label, embedding, speaking_seconds, ...).
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palaver.functions.scalars import BANDS, band, display_name, review_priority, review_reason, stable_id, status_rank
from palaver.operators.nearest import nearest, units, vector_norm, within
from palaver.storage import settled

STATUS = ("unknown", "candidate", "probable", "confirmed")


def best_match(queries: DataFrame, candidates: DataFrame, threshold: float = 0.7, observed: list | None = None) -> DataFrame:
    """(query_id, match_id, score): the candidate of the largest cosine, the first by pos among equals; no match below the threshold, the score stays.

    queries: (query_id, embedding); candidates: (candidate_id, pos, embedding). The search is exact and opens only candidates near enough (see ``nearest``); ``observed`` gets the numbers of pairs scored.
    Vectors that are null, without length or of different lengths have the score 0.
    """
    known, asked = units(candidates.select(F.col("candidate_id").alias("id"), "pos", "embedding")), units(queries.select(F.col("query_id").alias("q"), "embedding"))
    near = nearest(asked, known, observed).select(F.col("q").alias("query_id"), F.struct((-F.col("score")).alias("less"), "pos", "id").alias("m"))
    # Candidates that have no angle with a query score 0: the first one of all, or the first one of another length than the query's.
    dims = candidates.select(F.struct("pos", F.col("candidate_id").alias("id")).alias("c"), F.when(F.coalesce(vector_norm(F.col("embedding")), F.lit(0.0)) > 0, F.size("embedding")).otherwise(-1).alias("d"))
    firsts = dims.groupBy("d").agg(F.min("c").alias("c")).orderBy("c").limit(2).agg(F.sort_array(F.collect_list(F.struct("c", "d"))).alias("f"))  # one row
    own = F.when(F.coalesce(vector_norm(F.col("embedding")), F.lit(0.0)) > 0, F.size("embedding")).otherwise(-2)
    other = F.when(F.get("f", F.lit(0))["d"] != own, F.get("f", F.lit(0))["c"]).otherwise(F.get("f", F.lit(1))["c"])
    zero = queries.select("query_id", "embedding").join(F.broadcast(firsts)).select("query_id", other.alias("c")).filter("c IS NOT NULL")
    zero = zero.select("query_id", F.struct(F.lit(0.0).alias("less"), F.col("c.pos").alias("pos"), F.col("c.id").alias("id")).alias("m"))
    best = near.unionByName(zero).groupBy("query_id").agg(F.min("m").alias("m"))
    # Adding 0 turns a score of minus zero into zero.
    return queries.select("query_id").join(best, "query_id", "left").select("query_id", F.when(-F.col("m.less") >= threshold, F.col("m.id")).alias("match_id"), F.coalesce(-F.col("m.less") + 0.0, F.lit(0.0)).alias("score"))


def all_scores(vectors: DataFrame, known: DataFrame, least: float) -> DataFrame:
    """(call_id, label, name, score) of every vector (call_id, label, embedding) with every known one (name, embedding) from the cosine ``least`` on, which must be above 0.

    Known vectors that can't be near enough are not compared (see ``nearest``), and only pairs that are become rows.
    """
    names = units(known.select(F.col("name").alias("id"), F.lit(0).alias("pos"), "embedding"))
    return within(units(vectors.select("call_id", "label", "embedding")), names, ["call_id", "label"], least).select("call_id", "label", F.col("id").alias("name"), "score")


def centroids(vectors: DataFrame, key: str = "label") -> DataFrame:
    """(key, centroid, sample_count): element-wise mean; the order of a running mean does not matter."""
    flat = vectors.filter(F.col("embedding").isNotNull()).select(key, F.posexplode("embedding").alias("i", "x"))
    means = flat.groupBy(key, "i").agg(F.avg(F.col("x").cast("double")).alias("m"), F.count("*").alias("n"))
    return means.groupBy(key).agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "m"))), lambda s: s["m"]).alias("centroid"), F.max("n").alias("sample_count"))


def add_sample(centroid: Column, samples: Column, vector: Column) -> Column:
    """Running mean after one more vector."""
    return F.zip_with(centroid, vector, lambda a, b: (a * samples + b) / (samples + 1))


def greedy_assignment(scores: DataFrame, threshold: float) -> DataFrame:
    """(call_id, label, name, score): one-to-one pairs of each call by descending score (ties by label, then name), down to the threshold.

    In each round the pairs that come first for both their label and their name are taken, and all that share either with them go. These are the pairs that going through
    all of them in order would take, so the result is the same, but every round is a few aggregations over all calls at once. Rows without a label or name are left out.
    """
    left = scores.select("call_id", F.col("label").cast("string").alias("label"), F.col("name").cast("string").alias("name"), F.col("score").cast("double").alias("score")).filter((F.col("score") >= threshold) & F.col("label").isNotNull() & F.col("name").isNotNull())
    left, taken = settled(left.groupBy("call_id", "label", "name").agg(F.max("score").alias("score"))), []
    while True:
        first = F.min(F.struct((-F.col("score")).alias("less"), "label", "name")).alias("m")
        of_label, of_name = (left.groupBy("call_id", k).agg(first).select("call_id", "m.*") for k in ("label", "name"))
        keep = settled(of_label.join(of_name.select("call_id", "label", "name"), ["call_id", "label", "name"]).select("call_id", "label", "name", (-F.col("less")).alias("score")))
        if keep.isEmpty():
            break
        taken.append(keep)
        left = settled(left.join(keep, ["call_id", "label"], "left_anti").join(keep, ["call_id", "name"], "left_anti"))
    found = left.limit(0) if not taken else taken[0]
    for keep in taken[1:]:
        found = found.unionByName(keep)
    return found


def final_targets(identities: DataFrame, merges: DataFrame) -> DataFrame:
    """(_s, _t): merges between known clusters, with chains a -> b -> c of any length followed to their end by doubling pointers. A merge with itself is an error, and so is a circle."""
    ids = identities.select("speaker_cluster_id")
    pairs = merges.select(F.col("source").alias("_s"), F.when(F.col("source") == F.col("target"), F.raise_error(F.lit("a cluster can't be merged with itself"))).otherwise(F.col("target")).alias("_t"))
    pairs = pairs.join(ids.withColumnRenamed("speaker_cluster_id", "_s"), "_s", "left_semi").join(ids.withColumnRenamed("speaker_cluster_id", "_t"), "_t", "left_semi").groupBy("_s").agg(F.min("_t").alias("_t"))
    now = settled(pairs)
    rounds = now.count().bit_length()  # no chain is longer than the number of merges
    for _ in range(rounds + 1):
        further = now.select(F.col("_s").alias("_t"), F.col("_t").alias("_u"))
        after = settled(now.join(further, "_t", "left").select("_s", F.coalesce("_u", "_t").alias("_t"), F.col("_u").isNotNull().alias("_moved")))
        now = after.select("_s", "_t")
        if after.filter("_moved").isEmpty():
            return now
    raise ValueError("merges go in a circle")


def merge_clusters(identities: DataFrame, merges: DataFrame, updated_at: str | None = None) -> DataFrame:
    """Identities after merging ``source`` into ``target`` (rows of merges); a merge with itself is an error, one with an unknown cluster does nothing.

    The target keeps its name and status; names and aliases of the merged become aliases. Centroids are weighted by samples if the target has one, counters add up, first and last
    times widen, co-speakers are united and repointed everywhere.
    """
    pairs = final_targets(identities, merges)
    none = F.array().cast("array<string>")
    moved = identities.join(pairs, identities.speaker_cluster_id == F.col("_s"), "left").withColumn("_id", F.coalesce("_t", "speaker_cluster_id")).withColumn("_own", F.col("_t").isNull())
    n = F.coalesce("sample_count", F.lit(0))
    own = lambda c: F.max(F.when(F.col("_own"), F.struct(F.col(c))))[c]
    union = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_list(c))))
    name = F.nullif(F.col("canonical_name"), F.lit(""))
    renamed = F.when(~F.col("_own") & name.isNotNull(), F.array(name)).otherwise(none)
    updated = F.max("updated_at") if updated_at is None else F.when(F.max(~F.col("_own")), F.lit(updated_at)).otherwise(F.max("updated_at"))
    totals = moved.groupBy("_id").agg(
        own("canonical_name").alias("canonical_name"), union(F.concat(F.coalesce("aliases", none), renamed)).alias("aliases"), own("status").alias("status"), F.sum(n).alias("sample_count"), F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"),
        F.sum("total_calls").alias("total_calls"), F.sum("total_speaking_seconds").alias("total_speaking_seconds"), union(F.coalesce("typical_co_speakers", none)).alias("typical_co_speakers"), own("created_from").alias("created_from"), updated.alias("updated_at"),
    )
    flat = moved.filter(F.col("embedding_centroid").isNotNull()).select("_id", "_own", n.alias("n"), F.posexplode("embedding_centroid").alias("i", "x"))
    sums = flat.groupBy("_id", "i").agg((F.sum(F.col("x") * F.col("n")) / F.nullif(F.sum("n"), F.lit(0))).alias("m"), F.max("_own").alias("_own")).filter("_own")
    means = sums.groupBy("_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "m"))), lambda s: s["m"]).alias("embedding_centroid"))
    merged = totals.join(means, "_id", "left").withColumnRenamed("_id", "speaker_cluster_id")
    listed = merged.select("speaker_cluster_id", F.explode("typical_co_speakers").alias("_s")).join(pairs, "_s", "left").select("speaker_cluster_id", F.coalesce("_t", "_s").alias("c")).filter("c <> speaker_cluster_id")
    others = listed.groupBy("speaker_cluster_id").agg(F.array_sort(F.collect_set("c")).alias("_co"))
    out = merged.join(others, "speaker_cluster_id", "left").withColumn("typical_co_speakers", F.coalesce("_co", none))
    return out.select(*identities.columns)


def merge_evidence(identities: DataFrame, merges: DataFrame, created_at: str) -> DataFrame:
    """A record of evidence for each cluster that was merged into another."""
    gone = final_targets(identities, merges)
    return gone.select(
        stable_id("ev_", 8, F.lit("merge"), F.col("_s"), F.col("_t")).alias("evidence_id"), F.col("_t").alias("speaker_cluster_id"), F.lit("").alias("call_id"), F.lit("cluster_merge").alias("type"), F.lit(1.0).alias("score"),
        F.concat(F.lit("Merged "), F.col("_s"), F.lit(" into "), F.col("_t")).alias("summary"), F.create_map(F.lit("merged"), F.col("_s")).alias("details"), F.lit(created_at).alias("created_at"),
    )


def repoint(rows: DataFrame, merges: DataFrame, identities: DataFrame | None = None) -> DataFrame:
    """Occurrences or evidence with merged clusters replaced by their targets; ``identities`` has the known clusters, else all named are."""
    known = identities if identities is not None else merges.select(F.explode(F.array("source", "target")).alias("speaker_cluster_id")).distinct()
    return rows.join(final_targets(known, merges), rows.speaker_cluster_id == F.col("_s"), "left").withColumn("speaker_cluster_id", F.coalesce("_t", "speaker_cluster_id")).drop("_s", "_t")


def record_occurrences(identities: DataFrame, occurrences: DataFrame, seen_at: str) -> DataFrame:
    """Identities after more occurrences (speaker_cluster_id, call_id, total_speaking_seconds): calls and seconds add up, last_seen moves; unknown clusters are left out."""
    more = occurrences.groupBy("speaker_cluster_id").agg(F.count("*").alias("_n"), F.sum(F.coalesce("total_speaking_seconds", F.lit(0.0))).alias("_x"))
    hit = F.col("_n").isNotNull()
    joined = identities.join(more, "speaker_cluster_id", "left")
    new = {
        "total_calls": F.coalesce("total_calls", F.lit(0)) + F.coalesce("_n", F.lit(0)), "total_speaking_seconds": F.coalesce("total_speaking_seconds", F.lit(0.0)) + F.coalesce("_x", F.lit(0.0)),
        "last_seen": F.when(hit, F.lit(seen_at)).otherwise(F.col("last_seen")), "updated_at": F.when(hit, F.lit(seen_at)).otherwise(F.col("updated_at")),
    }
    return joined.select(*[new.get(c, F.col(c)).alias(c) for c in identities.columns])


def co_speakers(occurrences: DataFrame) -> DataFrame:
    """(speaker_cluster_id, co_speakers): other clusters that share a call, sorted."""
    a = occurrences.select("call_id", F.col("speaker_cluster_id").alias("a")).distinct()
    pairs = a.join(a.select("call_id", F.col("a").alias("b")), "call_id").filter("a <> b")
    return pairs.groupBy(F.col("a").alias("speaker_cluster_id")).agg(F.array_sort(F.collect_set("b")).alias("co_speakers"))


def upgraded(old: Column, new: Column) -> Column:
    """The higher of two statuses."""
    return F.element_at(F.array(*map(F.lit, STATUS)), F.greatest(status_rank(old), status_rank(new)) + 1)


def match_status(score: Column, existing: Column, bands: tuple = BANDS) -> Column:
    """Band of a match, with the rule for identities confirmed before: a strong match keeps them so, a weaker one is at least probable."""
    found = band(score, bands)
    return F.when((existing == "confirmed") & (score >= bands[0][0]), "confirmed").when(existing == "confirmed", upgraded(found, F.lit("probable"))).otherwise(found)


def aggregate_confidence(resolved: DataFrame, bands: tuple = BANDS) -> DataFrame:
    """``resolved`` (confidence, source, calendar_score, hint_score, status) after weighing all evidence: half the score of a voice match, 0.3 of the calendar's, 0.2 of the transcript's.

    Confirmed rows stay. A higher total becomes the confidence; if its band is higher than the status, the status rises and the source is ``aggregate``.
    """
    voice = F.when(F.col("source") == "db_match", F.col("confidence")).otherwise(F.lit(0.0))
    total = F.round(0.5 * voice + 0.3 * F.coalesce("calendar_score", F.lit(0.0)) + 0.2 * F.coalesce("hint_score", F.lit(0.0)), 9)
    better = (F.col("status") != "confirmed") & (F.col("_total") > F.col("confidence"))
    rises = better & (status_rank(band(F.col("_total"), bands)) > status_rank(F.col("status")))
    marked = resolved.withColumn("_total", total)
    return marked.withColumns({
        "confidence": F.when(better, F.col("_total")).otherwise(F.col("confidence")), "status": F.when(rises, band(F.col("_total"), bands)).otherwise(F.col("status")), "source": F.when(rises, F.lit("aggregate")).otherwise(F.col("source")),
    }).drop("_total")


CANDIDATES = "array<struct<name:string,score:double,source:string>>"


def name_stages(resolved: DataFrame, attendees: DataFrame | None = None, hints: DataFrame | None = None) -> DataFrame:
    """``resolved`` (call_id, local_label, status, ...) with ``candidate_names``, ``calendar_score`` and ``hint_score``, ready for ``aggregate_confidence``.

    attendees: (call_id, pos, name, score) of the matched event, for the speakers still unknown or candidate; hints: (call_id, name, confidence, pattern, target) by the local label that they target.
    """
    empty = F.array().cast(CANDIDATES)
    out = resolved.withColumns({"candidate_names": empty, "calendar_score": F.lit(0.0), "hint_score": F.lit(0.0)})
    found = lambda order: F.transform(F.sort_array(F.collect_list(F.struct(*order, F.struct("name", "score", "source").alias("c")))), lambda s: s["c"])
    if attendees is not None:
        rows = attendees.select("call_id", "pos", "name", F.col("score").cast("double").alias("score"), F.lit("calendar_attendee").alias("source"))
        each = rows.groupBy("call_id").agg(found(["pos"]).alias("_c"), F.max("score").alias("_s"))
        open_ = F.col("status").isin("unknown", "candidate")
        out = out.join(each, "call_id", "left").withColumns({"candidate_names": F.when(open_ & F.col("_c").isNotNull(), F.col("_c")).otherwise(empty), "calendar_score": F.when(open_, F.coalesce("_s", F.lit(0.0))).otherwise(0.0)}).drop("_c", "_s")
    if hints is not None:
        rows = hints.select("call_id", F.col("target").alias("local_label"), F.col("pos").alias("at"), "name", F.col("confidence").cast("double").alias("score"), F.concat(F.lit("transcript_"), F.col("pattern")).alias("source"))
        each = rows.groupBy("call_id", "local_label").agg(found(["at", "source", "name"]).alias("_c"), F.max("score").alias("_s"))
        out = out.join(each, ["call_id", "local_label"], "left").withColumns({"candidate_names": F.concat("candidate_names", F.coalesce("_c", empty)), "hint_score": F.coalesce("_s", F.lit(0.0))}).drop("_c", "_s")
    return out


def name_evidence(named: DataFrame, created_at: str) -> DataFrame:
    """Evidence records of the candidate names of resolved speakers, one for each name and source."""
    flat = named.select("call_id", "speaker_cluster_id", F.explode("candidate_names").alias("c")).distinct()
    kind = F.when(F.col("c.source") == "calendar_attendee", "calendar_overlap").otherwise("transcript_hint")
    return flat.select(
        stable_id("ev_", 8, F.col("call_id").cast("string"), F.col("speaker_cluster_id"), F.col("c.name"), F.col("c.source")).alias("evidence_id"), "speaker_cluster_id", F.col("call_id").cast("string").alias("call_id"), kind.alias("type"), F.col("c.score").alias("score"),
        F.concat(F.lit("Name '"), F.col("c.name"), F.lit("' by "), F.col("c.source")).alias("summary"), F.create_map(F.lit("source"), F.col("c.source")).alias("details"), F.lit(created_at).alias("created_at"),
    )


def update_co_speakers(identities: DataFrame, occurrences: DataFrame) -> DataFrame:
    """Identities with the clusters that shared a call united with those listed before."""
    joined = identities.join(co_speakers(occurrences), "speaker_cluster_id", "left")
    none = F.array().cast("array<string>")
    both = F.array_sort(F.array_union(F.coalesce("typical_co_speakers", none), F.coalesce("co_speakers", none)))
    return joined.withColumn("typical_co_speakers", F.when(F.col("co_speakers").isNotNull(), both).otherwise(F.col("typical_co_speakers"))).select(*identities.columns)


def apply_agreement(identities: DataFrame, hints: DataFrame) -> DataFrame:
    """Identities with the status that most agreeing names give, where it is higher than theirs."""
    found = agreement_status(hints).groupBy("speaker_cluster_id").agg(F.max(F.struct(status_rank(F.col("status")).alias("r"), "status"))["status"].alias("_s"))
    joined = identities.join(found, "speaker_cluster_id", "left")
    return joined.withColumn("status", F.when(F.col("_s").isNotNull(), upgraded(F.col("status"), F.col("_s"))).otherwise(F.col("status"))).select(*identities.columns)


def agreement_status(hints: DataFrame) -> DataFrame:
    """(speaker_cluster_id, name, agreements, status) from names given by a model: three agree confirmed, two probable, one candidate."""
    counts = hints.filter("name IS NOT NULL AND name <> ''").groupBy("speaker_cluster_id", F.lower("name").alias("k")).agg(F.count("*").alias("agreements"), F.min("name").alias("name"))
    n = F.col("agreements")
    return counts.select("speaker_cluster_id", "name", "agreements", F.when(n >= 3, "confirmed").when(n >= 2, "probable").otherwise("candidate").alias("status"))


class Clusters:
    """The evolving centroids of one tenant while its calls are resolved in order."""

    def __init__(self, threshold: float, bands: tuple = BANDS):
        self.threshold, self.bands = threshold, bands
        self.ids: list[str] = []
        self.sums: list[np.ndarray] = []
        self.rows = np.zeros((0, 0))  # unit vectors; doubled when full
        self.counts: list[int] = []
        self.status: list[int] = []

    def match(self, vector: np.ndarray, used: set[int]) -> tuple[int, float]:
        norm = float(np.linalg.norm(vector))
        if not self.ids or norm == 0 or self.rows.shape[1] != len(vector):
            return -1, 0.0
        scores = np.round(self.rows[: len(self.ids)] @ (vector / norm), 9)
        scores[list(used)] = -2.0
        best = int(np.argmax(scores))
        return (best, float(scores[best])) if scores[best] >= self.threshold else (-1, float(max(scores[best], 0.0)))

    def band(self, score: float) -> int:
        return next((STATUS.index(name) for least, name in self.bands if score >= least), 0)

    def update(self, at: int, vector: np.ndarray, score: float) -> str:
        found = self.band(score)
        if self.status[at] == 3:
            found = 3 if score >= self.bands[0][0] else max(found, 2)
        self.sums[at] = self.sums[at] + vector
        self.counts[at] += 1
        self.status[at] = max(self.status[at], found)
        self.rows[at] = self.sums[at] / max(np.linalg.norm(self.sums[at]), 1e-300)
        return STATUS[found]

    def create(self, cluster: str, vector: np.ndarray, samples: int = 1, status: int = 0) -> int:
        self.ids.append(cluster)
        self.sums.append(vector * samples)
        self.counts.append(samples)
        self.status.append(status)
        if self.rows.shape[1] != len(vector):
            self.rows = np.zeros((max(16, len(self.ids)), len(vector)))
        if len(self.ids) > len(self.rows):
            self.rows = np.concatenate([self.rows, np.zeros_like(self.rows)])
        self.rows[len(self.ids) - 1] = vector / max(np.linalg.norm(vector), 1e-300)
        return len(self.ids) - 1


def resolve_calls(speakers: DataFrame, threshold: float = 0.7, tenant: str | None = None, bands: tuple = BANDS) -> DataFrame:
    """(call_id, local_label, speaker_cluster_id, status, confidence, source): each local speaker's cluster.

    Calls are taken in order, and the speakers of a call by speaking time; each takes the best cluster not yet used in its call, or founds one. A call sees the
    centroids that the calls before left, so a tenant is sequential by nature and is one group; tenants run side by side.
    speakers: (call_id, call_order, local_label, embedding, speaking_seconds[, tenant]).
    """
    kind = speakers.schema["call_id"].dataType.simpleString()
    keyed = speakers.withColumn("_id", stable_id("spk_", 8, F.col("call_id").cast("string"), F.col("local_label").cast("string")))

    def fold(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["call_order", "call_id", "speaking_seconds", "local_label"], ascending=[True, True, False, True], kind="stable")
        state, out, call, used = Clusters(threshold, bands), [], object(), set()
        for r in rows.itertuples(index=False):
            if r.call_id != call:
                call, used = r.call_id, set()
            vector = np.asarray(r.embedding, float)
            at, score = state.match(vector, used)
            if at >= 0:
                out.append((r.call_id, r.local_label, state.ids[at], state.update(at, vector, score), score, "db_match"))
            else:
                at = state.create(r.cluster, vector)
                out.append((r.call_id, r.local_label, r.cluster, "unknown", 1.0, "auto_cluster"))
            used.add(at)
        return pd.DataFrame(out, columns=["call_id", "local_label", "speaker_cluster_id", "status", "confidence", "source"])

    narrow = keyed.select(
        (F.col(tenant) if tenant else F.lit("all")).alias("_tenant"), "call_id", "call_order", F.col("local_label").cast("string").alias("local_label"), F.col("embedding").cast("array<double>").alias("embedding"), "speaking_seconds", F.col("_id").alias("cluster")
    )
    return narrow.groupBy("_tenant").applyInPandas(fold, f"call_id {kind}, local_label string, speaker_cluster_id string, status string, confidence double, source string")


def label_segments(segments: DataFrame, resolutions: DataFrame) -> DataFrame:
    """``segments`` with cluster, name and confidence of their local speaker; unknown labels stay as they are."""
    r = resolutions.select("call_id", F.col("local_label").alias("speaker"), F.col("speaker_cluster_id").alias("_c"), F.col("display_name").alias("_n"), F.col("confidence").alias("_p"))
    joined = segments.join(r, ["call_id", "speaker"], "left")
    return joined.withColumn("speaker_cluster_id", F.col("_c")).withColumn("speaker_confidence", F.col("_p")).withColumn("speaker", F.coalesce(F.nullif(F.col("_n"), F.lit("")), "_c", "speaker")).drop("_c", "_n", "_p")


def model_speakers(named: DataFrame, resolutions: DataFrame) -> DataFrame:
    """Speakers named by a model (call_id, label, name) with the cluster whose local label, else whose id, is the label; two equi-joins instead of an OR."""
    by_label = resolutions.select("call_id", F.col("local_label").alias("label"), F.col("speaker_cluster_id").alias("_a")).dropDuplicates(["call_id", "label"])
    by_id = resolutions.select("call_id", F.col("speaker_cluster_id").alias("label"), F.col("speaker_cluster_id").alias("_b")).dropDuplicates(["call_id", "label"])
    return named.join(by_label, ["call_id", "label"], "left").join(by_id, ["call_id", "label"], "left").withColumn("speaker_cluster_id", F.coalesce("_a", "_b")).drop("_a", "_b")


def confirm(identities: DataFrame, names: DataFrame, updated_at: str) -> DataFrame:
    """Identities with a name (speaker_cluster_id, name) confirmed; the name before becomes an alias."""
    joined = identities.join(names.withColumnRenamed("name", "_n"), "speaker_cluster_id", "left")
    old = F.nullif(F.col("canonical_name"), F.lit(""))
    kept = F.coalesce("aliases", F.array().cast("array<string>"))
    more = F.when(F.col("_n").isNotNull() & old.isNotNull() & (old != F.col("_n")), F.array_union(kept, F.array(old))).otherwise(kept)
    hit = F.col("_n").isNotNull()
    return joined.select(*[
        {"aliases": more, "canonical_name": F.coalesce("_n", "canonical_name"), "status": F.when(hit, "confirmed").otherwise(F.col("status")), "updated_at": F.when(hit, updated_at).otherwise(F.col("updated_at"))}.get(c, F.col(c)).alias(c)
        for c in identities.columns
    ])


def set_status(identities: DataFrame, statuses: DataFrame) -> DataFrame:
    """Identities with the given status (speaker_cluster_id, status)."""
    joined = identities.join(statuses.select("speaker_cluster_id", F.col("status").alias("_s")), "speaker_cluster_id", "left")
    return joined.withColumn("status", F.coalesce("_s", "status")).select(*identities.columns)


def add_aliases(identities: DataFrame, aliases: DataFrame) -> DataFrame:
    """Identities with more aliases (speaker_cluster_id, alias)."""
    more = aliases.groupBy("speaker_cluster_id").agg(F.array_sort(F.collect_set("alias")).alias("_a"))
    joined = identities.join(more, "speaker_cluster_id", "left")
    return joined.withColumn("aliases", F.when(F.col("_a").isNotNull(), F.array_union(F.coalesce("aliases", F.array().cast("array<string>")), "_a")).otherwise(F.col("aliases"))).select(*identities.columns)


def enroll(identities: DataFrame, recordings: DataFrame, updated_at: str, least: float = 0.80) -> DataFrame:
    """Identities after enrolling named recordings (call_id, name, local_label, embedding, speaking_seconds).

    The speaker with most time in a recording is enrolled: a match of at least ``least`` is confirmed under the name, else a confirmed identity is added.
    """
    main = recordings.groupBy("call_id", "name").agg(F.max_by(F.struct("local_label", "embedding", "speaking_seconds"), F.struct("speaking_seconds", F.col("local_label"))).alias("m")).select("call_id", "name", "m.*")
    known = identities.filter(F.col("embedding_centroid").isNotNull()).select(F.col("speaker_cluster_id").alias("candidate_id"), F.col("speaker_cluster_id").alias("pos"), F.col("embedding_centroid").alias("embedding"))
    found = best_match(main.select(F.col("call_id").alias("query_id"), "embedding"), known, least)
    joined = main.join(found, main.call_id == found.query_id)
    confirmed = confirm(identities, joined.filter("match_id IS NOT NULL").groupBy(F.col("match_id").alias("speaker_cluster_id")).agg(F.min("name").alias("name")), updated_at)
    new = joined.filter("match_id IS NULL").select(
        stable_id("spk_", 8, F.col("call_id").cast("string"), F.col("local_label")).alias("speaker_cluster_id"), F.col("name").alias("canonical_name"), F.array().cast("array<string>").alias("aliases"), F.lit("confirmed").alias("status"),
        F.col("embedding").cast("array<double>").alias("embedding_centroid"), F.lit(1).cast("bigint").alias("sample_count"), F.lit(updated_at).alias("first_seen"), F.lit(updated_at).alias("last_seen"), F.lit(1).cast("bigint").alias("total_calls"),
        F.col("speaking_seconds").cast("double").alias("total_speaking_seconds"), F.array().cast("array<string>").alias("typical_co_speakers"), F.lit("enrollment").alias("created_from"), F.lit(updated_at).alias("updated_at"),
    )
    return confirmed.unionByName(new)


def identity_list(identities: DataFrame, most_co: int = 5) -> DataFrame:
    """Identities by number of calls, with display name and the first co-speakers."""
    shown = identities.select("speaker_cluster_id", display_name(F.col("canonical_name"), F.col("aliases"), F.col("speaker_cluster_id")).alias("display_name"), "status", "total_calls", "total_speaking_seconds", F.slice("typical_co_speakers", 1, most_co).alias("co_speakers"))
    return shown.orderBy(F.desc("total_calls"), "speaker_cluster_id")


def identity_counts(identities: DataFrame) -> DataFrame:
    return identities.agg(F.count("*").alias("total"), F.count_if(F.col("status") == "confirmed").alias("confirmed"), F.count_if(F.col("status") == "unknown").alias("unknown"))


def review_queue(identities: DataFrame, min_calls: int = 1, top: int = 20) -> DataFrame:
    """The most urgent unnamed identities: unknown or candidate with enough calls, by rounded priority."""
    open_ = identities.filter(F.col("status").isin("unknown", "candidate") & (F.col("total_calls") >= min_calls))
    seconds, calls = F.col("total_speaking_seconds"), F.col("total_calls")
    scored = open_.select("speaker_cluster_id", review_priority(seconds, calls, F.col("sample_count")).alias("priority"), review_reason(seconds, calls).alias("reason"), "total_calls", "total_speaking_seconds")
    return scored.orderBy(F.desc("priority"), "speaker_cluster_id").limit(top)


def review_summary(queue: DataFrame, identities: DataFrame) -> DataFrame:
    """Queue rows with minutes, last_seen and a line for people."""
    joined = queue.join(identities.select("speaker_cluster_id", "typical_co_speakers", "last_seen"), "speaker_cluster_id")
    minutes = F.bround(F.col("total_speaking_seconds") / 60, 1)
    co = F.slice(F.coalesce("typical_co_speakers", F.array().cast("array<string>")), 1, 3)
    line = F.concat_ws(
        ". ", F.concat(F.lit("Unknown speaker in "), F.col("total_calls").cast("string"), F.lit(" call(s)")), F.concat(F.format_string("%.1f", minutes), F.lit(" min total")), F.when(F.size(co) > 0, F.concat(F.lit("co-speakers: "), F.array_join(co, ", ")))
    )
    return joined.withColumns({"summary": line, "minutes": minutes}).drop("typical_co_speakers")


def confirmed_speakers(identities: DataFrame) -> DataFrame:
    """(speaker_cluster_id, name, calls, minutes) of confirmed identities, those of most calls first."""
    rows = identities.filter("status = 'confirmed'").select("speaker_cluster_id", F.col("canonical_name").alias("name"), F.col("total_calls").alias("calls"), F.bround(F.col("total_speaking_seconds") / 60, 1).alias("minutes"))
    return rows.orderBy(F.desc("calls"), "speaker_cluster_id")


def split_report(identities: DataFrame, occurrences: DataFrame, cluster: str) -> DataFrame:
    """The identity to be split with its occurrences; splitting itself is left to people."""
    return identities.filter(F.col("speaker_cluster_id") == cluster).join(occurrences.filter(F.col("speaker_cluster_id") == cluster).drop("speaker_cluster_id"), how="left", on=F.lit(True))


def migrate_v1(speakers: DataFrame, now: str) -> DataFrame:
    """Identities from the first format: a map of name to embedding and samples becomes confirmed identities."""
    return speakers.select(
        stable_id("spk_", 8, F.col("name")).alias("speaker_cluster_id"), F.col("name").alias("canonical_name"), F.array().cast("array<string>").alias("aliases"), F.lit("confirmed").alias("status"),
        F.col("embedding").cast("array<double>").alias("embedding_centroid"), F.coalesce("num_samples", F.lit(1)).cast("bigint").alias("sample_count"), F.lit(now).alias("first_seen"), F.lit(now).alias("last_seen"), F.lit(0).cast("bigint").alias("total_calls"),
        F.lit(0.0).alias("total_speaking_seconds"), F.array().cast("array<string>").alias("typical_co_speakers"), F.lit("migration").alias("created_from"), F.lit(now).alias("updated_at"),
    )



def unknown_speakers(identities: DataFrame, min_calls: int = 1) -> DataFrame:
    """Identities still unknown or candidate, with enough calls."""
    return identities.filter(F.col("status").isin("unknown", "candidate") & (F.col("total_calls") >= min_calls))


def occurrences_of(occurrences: DataFrame, cluster: str | None = None, call_id=None) -> DataFrame:
    """Occurrences of a cluster, in a call, or both."""
    out = occurrences
    if cluster is not None:
        out = out.filter(F.col("speaker_cluster_id") == cluster)
    return out if call_id is None else out.filter(F.col("call_id") == call_id)


def add_samples(speakers: DataFrame, samples: DataFrame) -> DataFrame:
    """A name-to-vector table (name, embedding, num_samples) after more vectors (name, embedding): a weighted mean of old and new."""
    new = samples.select("name", F.col("embedding").cast("array<double>").alias("embedding"), F.lit(1).cast("bigint").alias("num_samples"))
    every = speakers.select("name", F.col("embedding").cast("array<double>").alias("embedding"), F.col("num_samples").cast("bigint").alias("num_samples")).unionByName(new)
    flat = every.select("name", F.col("num_samples").alias("n"), F.posexplode("embedding").alias("i", "x"))
    sums = flat.groupBy("name", "i").agg((F.sum(F.col("x") * F.col("n")) / F.sum("n")).alias("m"), F.sum("n").alias("n"))
    return sums.groupBy("name").agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "m"))), lambda s: s["m"]).alias("embedding"), F.max("n").alias("num_samples"))


def remove_names(speakers: DataFrame, names: DataFrame) -> DataFrame:
    return speakers.join(names.select("name"), "name", "left_anti")
