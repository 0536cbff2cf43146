"""Analytical queries over the corpus: statistics, search, digest, cost and show."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palaver.functions.scalars import content_hash, llm_cost, minutes_clock, snippet, word_count

#: US dollars per million tokens for models without a price of their own.
DEFAULT_PRICE = (3.00, 15.00)


def speaker_stats(segments: DataFrame) -> DataFrame:
    """Segments and words of each speaker of a call."""
    return segments.groupBy("call_id", F.coalesce("speaker", F.lit("unknown")).alias("speaker")).agg(F.count("*").alias("segments"), F.sum(word_count(F.col("text"))).alias("words"))


def speaking_time(turns: DataFrame) -> DataFrame:
    """Seconds of each speaker of a call."""
    return turns.groupBy("call_id", F.coalesce("speaker", F.lit("")).alias("speaker")).agg(F.sum(F.col("end") - F.col("start")).alias("seconds"))


def primary_speaker(turns: DataFrame) -> DataFrame:
    """The speaker with most time in a call; the one met first among equals."""
    totals = turns.groupBy("call_id", "speaker").agg(F.sum(F.col("end") - F.col("start")).alias("seconds"), F.min("pos").alias("first_pos"))
    return totals.groupBy("call_id").agg(F.max(F.struct(F.round("seconds", 9).alias("s"), (-F.col("first_pos")).alias("p"), "speaker")).alias("m")).select("call_id", "m.speaker", F.col("m.s").alias("seconds"))


def search_full_text(calls: DataFrame, query: str) -> DataFrame:
    """(call_id, match, pos, speaker, snippet): calls whose whole text has the query; nothing for an empty query."""
    hits = calls.filter(F.lit(bool(query)) & F.contains(F.lower("text"), F.lower(F.lit(query))))
    return hits.select("call_id", F.lit("full_text").alias("match"), F.lit(None).cast("int").alias("pos"), F.lit(None).cast("string").alias("speaker"), snippet(F.col("text"), F.lit(query)).alias("snippet"))


def search_segments(segments: DataFrame, query: str, speaker: str | None = None, by_cluster: bool = False) -> DataFrame:
    """Segments with the query, of the speaker if one is given; an empty query matches every segment."""
    label = F.coalesce("speaker", F.lit("unknown"))
    hits = segments.filter(F.contains(F.lower(F.coalesce("text", F.lit(""))), F.lower(F.lit(query))))
    if speaker is not None:
        hits = hits.filter((label == speaker) | (F.col("speaker_cluster_id") == speaker if by_cluster else F.lit(False)))
    return hits.select("call_id", F.lit("segment").alias("match"), F.col("pos").cast("int").alias("pos"), label.alias("speaker"), snippet(F.coalesce("text", F.lit("")), F.lit(query)).alias("snippet"))


def search(calls: DataFrame, segments: DataFrame, query: str, speaker: str | None = None) -> DataFrame:
    """Full-text and segment hits; a speaker leaves the segments only."""
    some = search_segments(segments, query, speaker)
    return some if speaker is not None else search_full_text(calls, query).unionByName(some)


def search_topics(calls: DataFrame, topic: str) -> DataFrame:
    """(call_id, topic): topics that have the text, whatever the case."""
    return calls.select("call_id", F.explode("topics").alias("topic")).filter(F.contains(F.lower("topic"), F.lower(F.lit(topic))))


def since(times: Column, as_of: str, days: int) -> Column:
    return times >= F.lit(as_of).cast("timestamp") - F.expr(f"INTERVAL {int(days)} DAYS")


def creation_time(*texts: Column) -> Column:
    """The first text that is a time, in UTC."""
    return F.coalesce(*[F.try_to_timestamp(t) for t in texts])


def top_counts(values: DataFrame, column: str, order: str, top: int = 10) -> DataFrame:
    """(value, n): the most frequent values; the one met first among equals."""
    counts = values.groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n"), F.min(order).alias("_first"))
    return counts.orderBy(F.desc("n"), "_first").limit(top).drop("_first")


def digest(calls: DataFrame, unnamed_prefix: str = "spk_") -> DataFrame:
    """One row: calls, hours, distinct named and unnamed speakers, calls and minutes with unnamed ones, and action items.

    calls: (call_id, duration_seconds, speakers array<string>, action_items array<string>).
    """
    people = F.explode_outer("speakers")
    flat = calls.select("call_id", "duration_seconds", people.alias("s"))
    unnamed = F.col("s").startswith(unnamed_prefix)
    a = calls.agg(F.count("*").alias("calls"), F.round(F.coalesce(F.sum("duration_seconds"), F.lit(0.0)) / 3600, 2).alias("hours"), F.coalesce(F.sum(F.size(F.coalesce("action_items", F.array().cast("array<string>")))), F.lit(0)).cast("bigint").alias("action_items"))
    b = flat.agg(F.countDistinct(F.when(~unnamed, F.col("s"))).alias("named_speakers"), F.countDistinct(F.when(unnamed, F.col("s"))).alias("unnamed_speakers"))
    c = flat.filter(unnamed).select("call_id", "duration_seconds").distinct().agg(F.count("*").alias("unnamed_calls"), F.round(F.coalesce(F.sum("duration_seconds"), F.lit(0.0)) / 60, 2).alias("unnamed_minutes"))
    return a.crossJoin(b).crossJoin(c)  # each is one row


def unnamed_speakers(calls: DataFrame, unnamed_prefix: str = "spk_", top: int = 10) -> DataFrame:
    """(label, calls, minutes): the unnamed speakers of most calls, with the minutes of these calls."""
    flat = calls.select("call_id", "duration_seconds", F.explode(F.array_distinct("speakers")).alias("label")).filter(F.col("label").startswith(unnamed_prefix))
    counts = flat.groupBy("label").agg(F.count("*").alias("calls"), F.round(F.sum("duration_seconds") / 60, 1).alias("minutes"))
    return counts.orderBy(F.desc("calls"), "label").limit(top)


def call_list(calls: DataFrame) -> DataFrame:
    """(call_id, title, minutes, speakers): a line for each call of a digest."""
    return calls.select("call_id", "title", F.round(F.col("duration_seconds") / 60, 1).alias("minutes"), F.array_join("speakers", ", ").alias("speakers"))


def other_actions(top_level: Column, model: Column) -> Column:
    """Items of the first list that the second does not have, repeats kept, then the second list."""
    return F.concat(F.filter(top_level, lambda x: ~F.array_contains(model, x)), model)


def priced(log: DataFrame, prices: DataFrame) -> DataFrame:
    """Usage with its cost; prices: (model, input_price, output_price), one row per model."""
    joined = log.join(prices, "model", "left")
    return joined.withColumn("cost_usd", llm_cost(F.col("input_tokens"), F.col("output_tokens"), F.coalesce("input_price", F.lit(DEFAULT_PRICE[0])), F.coalesce("output_price", F.lit(DEFAULT_PRICE[1])))).drop("input_price", "output_price")


def cost_rollup(log: DataFrame, day: Column) -> DataFrame:
    """(kind, name, calls, input_tokens, output_tokens, cost_usd): total, by model and by day, in one aggregation over grouping sets."""
    days = log.withColumn("day", F.coalesce(day, F.lit("unknown"))).withColumn("model", F.coalesce("model", F.lit("unknown")))
    sets = days.groupingSets([[], ["model"], ["day"]], "model", "day").agg(
        F.grouping_id().alias("g"), F.count("*").alias("calls"), F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens"), F.round(F.sum("cost_usd"), 4).alias("cost_usd")
    )
    return sets.select(F.when(F.col("g") == 3, "total").when(F.col("g") == 1, "model").otherwise("day").alias("kind"), F.coalesce("model", "day", F.lit("")).alias("name"), "calls", "input_tokens", "output_tokens", "cost_usd")


def dry_run_cost(calls: DataFrame, output_tokens: int = 800, price: tuple = DEFAULT_PRICE) -> DataFrame:
    """One row: files, estimated tokens (a quarter of the characters) and cost before running a model."""
    total = calls.agg(F.count("*").alias("files"), F.coalesce(F.sum(F.floor(F.length("text") / 4)), F.lit(0)).cast("bigint").alias("input_tokens"))
    out = total.withColumn("output_tokens", F.col("files") * output_tokens)
    return out.withColumn("cost_usd", F.round(llm_cost(F.col("input_tokens"), F.col("output_tokens"), F.lit(price[0]), F.lit(price[1])), 4))


def show(calls: DataFrame, segments: DataFrame, call_id: str) -> DataFrame:
    """Lines of one call: position, clock, speaker and text."""
    mine = segments.filter(F.col("call_id") == call_id).join(calls.select("call_id", "title"), "call_id", "left")
    return mine.select("pos", minutes_clock(F.col("start")).alias("at"), F.coalesce("speaker", F.lit("unknown")).alias("speaker"), "text", "title").orderBy("pos")


def roster(named: DataFrame, segments: DataFrame) -> DataFrame:
    """Speakers named by a model (call_id, speaker, name) and those of the segments, each with counts, either may lack the other."""
    return named.join(speaker_stats(segments), ["call_id", "speaker"], "full_outer").select("call_id", "speaker", "name", F.coalesce("segments", F.lit(0)).alias("segments"), F.coalesce("words", F.lit(0)).alias("words"))


def latest_file(files: DataFrame) -> DataFrame:
    """The path of the file changed last."""
    return files.agg(F.max_by("path", F.struct("mtime", "path")).alias("path"))


def usage_summary(log: DataFrame) -> DataFrame:
    return log.agg(F.count("*").alias("calls"), F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens"), F.round(F.sum("cost_usd"), 6).alias("cost_usd"))


def hashed(files: DataFrame, content: str) -> DataFrame:
    return files.withColumn("hash", content_hash(F.col(content)))
