"""Conversation metrics: ratios, monologues, switches, latency, balance, rule-based classes and diarization error."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from palaver.functions.scalars import word_count
from palaver.operators.sequence import in_call
from palaver.operators.summary import sentences

#: Words that speak for a kind of meeting.
KEYWORDS = {
    "business-meeting": ["agenda", "action item", "quarterly", "revenue", "budget", "deadline", "stakeholder", "kpi"],
    "family": ["family", "kids", "school", "dinner", "vacation", "birthday", "holiday"],
    "brainstorm": ["idea", "brainstorm", "what if", "concept", "prototype", "explore", "creative"],
    "one-on-one": ["feedback", "career", "growth", "performance", "check-in", "1:1"],
    "interview": ["candidate", "resume", "experience", "tell me about", "why do you want"],
    "lecture": ["chapter", "slide", "homework", "exam", "textbook", "professor", "class"],
    "sales-call": ["demo", "pricing", "proposal", "contract", "close", "deal", "pipeline", "objection", "competitor", "roi", "discount", "trial", "procurement"],
    "discovery-call": ["tell me about", "pain point", "how do you currently", "what's your biggest challenge", "workflow", "frustration", "workaround", "use case"],
    "call": ["hello", "calling about", "phone", "voicemail"],
    "podcast": ["episode", "listener", "welcome back", "subscribe", "sponsor", "show notes"],
}


def talk_ratios(segments: DataFrame) -> DataFrame:
    """Per speaker of a call: words and their share, words per minute of speaking, share of sentences that end with a question mark, and how often "we", "our" or "us" come for each "I", "my" or "me" (null without any of these)."""
    text = F.coalesce("text", F.lit(""))
    count = lambda words: F.sum(F.regexp_count(F.lower(text), F.lit(rf"\b({words})\b")))
    said = sentences(text)
    asked = F.size(F.filter(said, lambda x: F.endswith(x, F.lit("?"))))
    mine = segments.groupBy("call_id", "speaker").agg(F.sum(word_count(text)).alias("words"), F.sum(F.size(said)).alias("n"), F.sum(asked).alias("q"), count("we|our|us").alias("we"), count("i|my|me").alias("i"), F.sum(F.col("end") - F.col("start")).alias("seconds"))
    total = F.sum("words").over(Window.partitionBy("call_id"))
    share = lambda x, y: F.round(F.when(y > 0, x / y).otherwise(0.0), 6)
    return mine.select(
        "call_id", "speaker", "words", share(F.col("words"), total).alias("talk_ratio"), share(60 * F.col("words"), F.col("seconds")).alias("words_per_minute"), share(F.col("q"), F.col("n")).alias("question_ratio"), F.round(F.when(F.col("i") > 0, F.col("we") / F.col("i")), 6).alias("we_ratio")
    )


def longest_monologue(segments: DataFrame) -> DataFrame:
    """(call_id, speaker, seconds): the longest run of segments of one speaker."""
    new = (F.lag("speaker").over(in_call()).isNull() | (F.lag("speaker").over(in_call()) != F.col("speaker"))).cast("int")
    runs = segments.withColumn("_n", new).withColumn("run", F.sum("_n").over(in_call())).groupBy("call_id", "run").agg(F.min("speaker").alias("speaker"), (F.max("end") - F.min("start")).alias("seconds"))
    return runs.groupBy("call_id").agg(F.max(F.struct("seconds", "speaker")).alias("m")).select("call_id", "m.speaker", "m.seconds")


def dynamics(segments: DataFrame) -> DataFrame:
    """Per call: switches of speaker, per minute, interruptions, mean response latency and the share of silence."""
    w = in_call("start")
    before = segments.withColumn("_s", F.lag("speaker").over(w)).withColumn("_e", F.lag("end").over(w)).withColumn("_m", F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1)))
    switch = F.col("_s").isNotNull() & (F.col("_s") != F.col("speaker"))
    gap = F.col("start") - F.col("_e")
    per = before.groupBy("call_id").agg(
        F.count_if(switch).alias("switches"),
        F.count_if(switch & (gap < 0)).alias("interruptions"),
        F.round(F.avg(F.when(switch & (gap >= 0), gap)), 6).alias("latency"),
        (F.max("end") - F.min("start")).alias("extent"),
        F.coalesce(F.sum(F.greatest(F.lit(0.0), F.col("start") - F.col("_m"))), F.lit(0.0)).alias("silence"),
    )
    some = F.col("extent") > 0
    return per.select("call_id", "switches", "interruptions", "latency", F.round(F.when(some, F.col("switches") / (F.col("extent") / 60)), 6).alias("switches_per_minute"), F.round(F.when(some, 100 * F.col("silence") / F.col("extent")), 6).alias("silence_pct"))


def participation_gini(totals: DataFrame, value: str = "words") -> DataFrame:
    """(call_id, speakers, gini): how unevenly a total is spread over the speakers; zero for equal shares."""
    w = Window.partitionBy("call_id").orderBy(value, "speaker")
    ranked = totals.withColumn("_r", F.row_number().over(w))
    g = ranked.groupBy("call_id").agg(F.count("*").alias("n"), F.sum(F.col("_r") * F.col(value)).alias("rx"), F.sum(value).alias("x"))
    return g.select("call_id", F.col("n").alias("speakers"), F.round(F.when(F.col("x") > 0, 2 * F.col("rx") / (F.col("n") * F.col("x")) - (F.col("n") + 1) / F.col("n")).otherwise(0.0), 6).alias("gini"))


def classify_meetings(segments: DataFrame, first_seconds: float = 120.0, keywords: dict[str, list[str]] = KEYWORDS) -> DataFrame:
    """(call_id, classification, score): keyword hits in the first minutes, with points for the number of speakers and the duration; none is ``other``."""
    early = F.when(F.col("start") < first_seconds, F.lower(F.coalesce("text", F.lit(""))))
    calls = segments.groupBy("call_id").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", early.alias("t")))), lambda s: F.coalesce(s["t"], F.lit(""))), " ").alias("t"), F.countDistinct("speaker").alias("people"), (F.max("end") - F.min("start")).alias("seconds")
    )
    people, seconds = F.col("people"), F.col("seconds")
    fits = {
        "voice-memo": (people == 1).cast("int") + (seconds < 120).cast("int"), "lecture": (people == 1).cast("int"), "call": (people == 2).cast("int") + seconds.between(120, 900).cast("int"), "one-on-one": (people == 2).cast("int"),
        "business-meeting": (people >= 3).cast("int") + (seconds > 900).cast("int"),
    }
    hits = lambda words: sum((F.regexp_count(F.col("t"), F.lit(r"\b" + w.replace(".", r"\.") + r"\b")) for w in words), F.lit(0))
    scores = [F.struct((2 * hits(keywords.get(k, [])) + fits.get(k, F.lit(0))).alias("score"), F.lit(-i).alias("p"), F.lit(k).alias("k")) for i, k in enumerate([*keywords, "voice-memo"])]
    best = calls.withColumn("b", F.array_max(F.array(*scores)))
    return best.select("call_id", F.when(F.col("b.score") > 0, F.col("b.k")).otherwise("other").alias("classification"), F.col("b.score").alias("score"))


#: Days that a deadline may name.
DAYS = "monday|tuesday|wednesday|thursday|friday|saturday|sunday|today|tonight|tomorrow|next week|next month|end of day|eod|end of week"
ACTION_RULE = rf"\b(action item|todo|to do|i will|i'll|we will|we'll|need to|follow up)\b|\baction:|\b[\w.'-]+ will\b.*\bby (the )?({DAYS}|\d)"
DECISION_RULE = r"\b(we decided|decision|agreed|approved|let's go with|we are going with)\b|\bresolution:"


def rule_actions(segments: DataFrame) -> DataFrame:
    """(call_id, pos, kind, text): sentences that name a decision, or an action (marked as one, promised, or what somebody will do by some day)."""
    said = segments.select("call_id", "pos", F.explode(F.split(F.coalesce("text", F.lit("")), r"(?<=[.!?])\s+")).alias("text"))
    rule = lambda r: F.rlike(F.lower("text"), F.lit(r))
    return said.select("call_id", "pos", F.when(rule(DECISION_RULE), "decision").when(rule(ACTION_RULE), "action").alias("kind"), "text").filter("kind IS NOT NULL")


def topic_segments(segments: DataFrame, min_pause: float = 5.0) -> DataFrame:
    """``segments`` with ``topic_no``: a new one after a pause over ``min_pause`` together with a change of speaker."""
    w = in_call()
    new = ((F.col("start") - F.lag("end").over(w) > min_pause) & (F.lag("speaker").over(w) != F.col("speaker"))).cast("int")
    return segments.withColumn("_n", F.coalesce(new, F.lit(0))).withColumn("topic_no", F.sum("_n").over(w).cast("bigint")).drop("_n")


def best_assignment(gain: np.ndarray) -> list[tuple[int, int]]:
    """Pairs (row, column), one-to-one, with the largest sum of gains: shortest augmenting paths with potentials, one row after the other."""
    if gain.shape[0] > gain.shape[1]:
        return [(i, j) for j, i in best_assignment(gain.T)]
    n, m = gain.shape
    u, v, owner = np.zeros(n + 1), np.zeros(m + 1), np.zeros(m + 1, int)  # row and column 0 stand for none
    for i in range(1, n + 1):
        owner[0], at = i, 0
        least, before, used = np.full(m + 1, np.inf), np.zeros(m + 1, int), np.zeros(m + 1, bool)
        while owner[at]:
            used[at] = True
            cost = -gain[owner[at] - 1] - u[owner[at]] - v[1:]
            nearer = ~used[1:] & (cost < least[1:])
            least[1:][nearer], before[1:][nearer] = cost[nearer], at
            new = int(np.argmin(np.where(used, np.inf, least)))
            step = least[new]
            u[owner[used]] += step
            v[used] -= step
            least[~used] -= step
            at = new
        while at:
            owner[at] = owner[before[at]]
            at = before[at]
    return [(int(owner[j]) - 1, j - 1) for j in range(1, m + 1) if owner[j]]


#: Turns, before they are cut, for each task of the sweep at most, as a mean.
TURNS = 40_000


def merged_turns(turns: DataFrame, width: float, parts: int) -> DataFrame:
    """Turns (call_id, side, speaker, a, b) cut at borders of bins, with ``_bin``, dealt to ``parts`` tasks by call and bin; those of one speaker that overlap or touch in a bin are one."""
    bins = F.sequence(F.floor(F.col("a") / width), F.floor(F.col("b") / width))
    cut = turns.withColumn("_bin", F.explode(bins)).withColumns({"a": F.greatest("a", F.col("_bin") * width), "b": F.least("b", (F.col("_bin") + 1) * width)}).filter("b > a").repartition(parts, "call_id", "_bin")
    w =Window.partitionBy("call_id", "_bin", "side", "speaker").orderBy("a", "b")
    reach = F.max("b").over(w.rowsBetween(Window.unboundedPreceding, -1))
    islands = cut.withColumn("_new", F.coalesce((F.col("a") > reach).cast("int"), F.lit(1))).withColumn("_island", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    return islands.groupBy("call_id", "_bin", "side", "speaker", "_island").agg(F.min("a").alias("a"), F.max("b").alias("b")).drop("_island")


def mapped_seconds(batches):
    """(call_id, right) of rows (call_id, h, r, s): the seconds in which the labels agree under the one-to-one mapping for which that is most."""
    for batch in batches:
        right = []
        for h, r, s in zip(batch["h"], batch["r"], batch["s"], strict=True):
            (_, i), (_, j) = (np.unique(np.asarray(x, str), return_inverse=True) for x in (h, r))
            gain = np.zeros((i.max() + 1, j.max() + 1))
            gain[i, j] = s
            right.append(float(sum(gain[pair] for pair in best_assignment(gain))))
        yield pd.DataFrame({"call_id": batch["call_id"], "right": right})


def diarization_error(reference: DataFrame, hypothesis: DataFrame, collar: float = 0.25, width: float = 60.0) -> DataFrame:
    """(call_id, missed, false_alarm, confusion, total, der): error against reference turns, without a collar around their borders.

    A sweep in every (call, bin of ``width`` seconds): between two marks (a turn or a collar begins or ends) the numbers of speakers are fixed, and their spans add up. The scored seconds up to each mark
    turn the time that two turns share into a difference of two numbers, and so give the matrix of hypothesis by reference labels; bins add up, so a long call is many tasks.
    All of the sweep follows one shuffle by (call, bin), to as many tasks as the number of turns asks for, so what a task holds does not grow with the table.
    Only that matrix, labels by labels, is one row for a call; the mapping of labels is the best one, whatever their number. Turns without a time or speaker, or of no length, do not count.
    """
    side = lambda df, name: df.select("call_id", F.lit(name).alias("side"), F.col("speaker").cast("string").alias("speaker"), F.col("start").cast("double").alias("a"), F.col("end").cast("double").alias("b"))
    both = side(reference, "r").unionByName(side(hypothesis, "h"))
    turns = both.filter(F.col("speaker").isNotNull() & (F.col("b") > F.col("a")))
    collars = turns.filter("side = 'r'").select("call_id", F.lit("c").alias("side"), F.lit("").alias("speaker"), F.explode(F.array("a", "b")).alias("t")).select("call_id", "side", "speaker", (F.col("t") - collar).alias("a"), (F.col("t") + collar).alias("b")).filter("b > a")
    parts = max(int(both.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-turns.count() // TURNS))
    swept = merged_turns(turns.unionByName(collars), width, parts)
    mark = lambda t, d: F.struct(F.col(t).alias("t"), F.lit(d).alias("d"))
    marks = swept.select("call_id", "_bin", "side", "speaker", F.col("a").alias("_from"), F.explode(F.array(mark("a", 1), mark("b", -1))).alias("e")).select("call_id", "_bin", "side", "speaker", "_from", "e.*")
    w = Window.partitionBy("call_id", "_bin").orderBy("t")
    level = lambda s: F.sum(F.when(F.col("side") == s, F.col("d")).otherwise(0)).over(w.rangeBetween(Window.unboundedPreceding, Window.currentRow))
    # Marks at one time have the same levels, and no span between them.
    levels = marks.select("*", *[level(s).alias(s) for s in "rhc"], F.coalesce(F.lead("t").over(w) - F.col("t"), F.lit(0.0)).alias("_gap"))
    spans = levels.withColumn("span", F.when(F.col("c") == 0, F.col("_gap")).otherwise(0.0))
    scored = spans.withColumn("upto", F.coalesce(F.sum("span").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
    r, h, span = F.col("r"), F.col("h"), F.col("span")
    sums = scored.groupBy("call_id").agg(F.sum(span * r).alias("total"), F.sum(span * F.greatest(F.lit(0), r - h)).alias("missed"), F.sum(span * F.greatest(F.lit(0), h - r)).alias("false_alarm"), F.sum(span * F.least(r, h)).alias("both"))
    placed = scored.filter("side <> 'c'").groupBy("call_id", "_bin", "side", "speaker", "_from").agg(F.min("upto").alias("_x"), F.max("upto").alias("_y")).filter("_y > _x")
    of = lambda s: placed.filter(F.col("side") == s).select("call_id", "_bin", F.col("speaker").alias(s), F.col("_x").alias(f"{s}x"), F.col("_y").alias(f"{s}y"))
    shared = F.least("hy", "ry") - F.greatest("hx", "rx")
    matrix = of("h").join(of("r"), ["call_id", "_bin"]).filter(shared > 0).groupBy("call_id", "h", "r").agg(F.sum(shared).alias("s"))
    listed = matrix.groupBy("call_id").agg(F.collect_list(F.struct("h", "r", "s")).alias("m")).select("call_id", *[F.col(f"m.{c}").alias(c) for c in "hrs"])
    right = listed.mapInPandas(mapped_seconds, f"call_id {both.schema['call_id'].dataType.simpleString()}, right double")
    found = both.select("call_id").distinct().join(sums, "call_id", "left").join(right, "call_id", "left")
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    parts = found.select("call_id", zero("missed").alias("missed"), zero("false_alarm").alias("false_alarm"), F.greatest(F.lit(0.0), zero(F.col("both")) - zero(F.col("right"))).alias("confusion"), zero("total").alias("total"))
    return parts.withColumn("der", F.when(F.col("total") > 0, (F.col("missed") + F.col("false_alarm") + F.col("confusion")) / F.col("total")).otherwise(0.0))
