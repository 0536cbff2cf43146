"""Order-dependent operators on the segments of a call: (call_id, pos, start, end, text, ...)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from palaver.functions.scalars import ngrams, strip, tokens
from palaver.operators.scan import BLOCK, chain, first_reaching, running
from palaver.storage import settled


def in_call(order: str = "pos"):
    return Window.partitionBy("call_id").orderBy(order)


def consecutive_dedup(segments: DataFrame) -> DataFrame:
    """Drops blank segments, and those whose stripped text equals that of the segment kept before."""
    text = strip(F.coalesce("text", F.lit("")))
    return segments.withColumn("_t", text).filter(F.col("_t") != "").withColumn("_before", F.lag("_t").over(in_call())).filter(F.col("_before").isNull() | (F.col("_before") != F.col("_t"))).drop("_t", "_before")


def repetition_flags(segments: DataFrame, threshold: float = 0.6, n: int = 3) -> DataFrame:
    """``segments`` with ``repeated``: share of the n-grams (a multiset) that the segment before has, against the threshold."""
    grams = segments.withColumn("_g", ngrams(tokens(F.col("text")), n)).withColumn("_p", F.lag("_g").over(in_call()))
    # Where either side repeats no gram, every shared gram counts once; only else are the smaller counts summed gram by gram.
    count = lambda arr, g: F.size(F.filter(arr, lambda x: x == g))
    once = lambda arr: F.size(F.array_distinct(arr)) == F.size(arr)
    common = F.array_intersect("_g", "_p")
    summed = F.aggregate(common, F.lit(0), lambda s, g: s + F.least(count(F.col("_g"), g), count(F.col("_p"), g)))
    shared = F.when(once(F.col("_g")) | once(F.col("_p")), F.size(common)).otherwise(summed)
    ratio = F.when((F.size("_g") > 0) & (F.size("_p") > 0), shared / F.size("_g")).otherwise(F.lit(0.0))
    return grams.withColumn("repeated", F.coalesce(ratio >= threshold, F.lit(False))).drop("_g", "_p")


def pause_splits(segments: DataFrame, min_pause: float = 3.0) -> DataFrame:
    """(call_id, pos, split): the middle of each gap of at least ``min_pause`` before segment ``pos``."""
    gap = segments.select("call_id", "pos", "start", F.lag("end").over(in_call()).alias("before"))
    return gap.filter(F.col("start") - F.col("before") >= min_pause).select("call_id", "pos", ((F.col("start") + F.col("before")) / 2).alias("split"))


def fixed_splits(segments: DataFrame, seconds: float) -> DataFrame:
    """(call_id, split): multiples of ``seconds`` after the start of a call and before its end."""
    extent = segments.groupBy("call_id").agg(F.min_by("start", "pos").alias("a"), F.max_by("end", "pos").alias("b"))
    steps = F.ceil((F.col("b") - F.col("a")) / seconds) - 1
    return extent.filter(steps >= 1).select("call_id", F.explode(F.transform(F.sequence(F.lit(1), steps), lambda i: F.col("a") + i * seconds)).alias("split"))


def next_chunks(line: DataFrame, splits: DataFrame, target: float, max_chars: int) -> DataFrame:
    """(call_id, at, to): for each segment ``at`` the segment before which the chunk that begins with it is cut.

    line: (call_id, pos, a, e, n, row, chars, top_a, top_e, first, last, paused) with running rows and characters and running maxima of the times; splits: (call_id, split).
    A segment is cut off if the characters would be too many, or if it ends ``target`` seconds after the chunk's start and a split lies between that start and its own.
    """
    look = lambda v, to, x, **how: first_reaching(line.select("call_id", F.col(v).alias("v"), to.alias("to")), x, "call_id", **how)
    here = lambda x: line.select("call_id", F.col("pos").alias("q"), x.alias("x"))
    joined = lambda df, found, name: df.join(found.select("call_id", F.col("q").alias("pos"), F.col("to").alias(name)), ["call_id", "pos"], "left")
    fitting = line.filter(F.col("n") <= max_chars).select("call_id", F.col("pos").alias("q"), (F.col("chars") - F.col("n") + max_chars).alias("x"))
    by_chars = look("chars", F.col("pos"), fitting, width=float(max(1, max_chars)), strict=True)
    # A segment that is too long by itself is a chunk.
    by_size = look("row", F.col("pos"), line.filter(F.col("n") > max_chars).select("call_id", F.col("pos").alias("q"), F.col("row").alias("x")), width=float(BLOCK), strict=True)
    pause = first_reaching(splits.select("call_id", F.col("split").alias("v"), F.col("split").alias("to")), here(F.col("a")), "call_id", target, strict=True)
    # Calls without a pause are split at multiples of the target.
    multiple = lambda k: F.col("first") + target * (F.floor((F.col("a") - F.col("first")) / target) + k)
    fixed = F.when(multiple(1) > F.col("a"), multiple(1)).otherwise(multiple(2))
    split = F.when(F.col("paused"), F.col("_s")).when(fixed < F.col("last"), fixed)
    asked = settled(joined(line, pause, "_s").select("call_id", "pos", (F.col("a") + target).alias("due"), split.alias("split")).filter("split IS NOT NULL"))
    ask = lambda name: asked.select("call_id", F.col("pos").alias("q"), F.col(name).alias("x"))
    begins = look("top_a", F.struct("pos", "e"), ask("split"), width=target)
    ends = look("top_e", F.col("pos"), ask("due"), width=target)
    timed = settled(joined(joined(asked, begins, "_j"), ends, "_k").filter("_j IS NOT NULL AND _k IS NOT NULL"))
    # The first segment that ends late enough may come before the first behind the split. Where that one then ends too early, later ones are tried; one that begins when it is due is late enough.
    plain = F.when(F.col("_k") >= F.col("_j.pos"), F.col("_k")).when(F.col("_j.e") >= F.col("due"), F.col("_j.pos"))
    rest = timed.filter(plain.isNull())
    bins = F.sequence(F.floor(F.col("split") / target), F.floor(F.col("due") / target))
    tried = rest.withColumn("_b", F.explode(bins)).join(line.select("call_id", F.col("pos").alias("_p"), F.col("e").alias("_e"), F.floor(F.col("top_a") / target).alias("_b")), ["call_id", "_b"])
    near = tried.filter("_p > _j.pos AND _e >= due").groupBy("call_id", F.col("pos").alias("q")).agg(F.min("_p").alias("to"))
    late = look("top_a", F.col("pos"), rest.select("call_id", F.col("pos").alias("q"), F.col("due").alias("x")), width=target)
    by_time = joined(joined(timed, near, "_n"), late, "_l").select("call_id", F.col("pos").alias("q"), F.coalesce(plain, "_n", "_l").alias("to"))
    both = joined(joined(line.select("call_id", "pos"), by_chars.unionByName(by_size), "_c"), by_time, "_t")
    return both.select("call_id", F.col("pos").alias("at"), F.least("_c", "_t").alias("to")).filter("to IS NOT NULL")


def chunk_ids(segments: DataFrame, target_minutes: float = 10.0, max_chars: int = 80_000, min_pause: float = 3.0) -> DataFrame:
    """``segments`` with the chunk each falls into. A call is one chunk if it is short in time and characters.

    Where the next chunk would begin is worked out for every segment, as if a chunk began with it; the chunks are then the chain of these
    pointers from the first segment on. Nothing runs over a call as a group: sums, maxima and look-ups work in blocks, the chain by doubling.
    A segment is taken to start no earlier than those before it, and to end no earlier than it starts.
    """
    target = target_minutes * 60
    base = segments.select("call_id", "pos", F.coalesce("start", F.lit(0.0)).alias("a"), F.coalesce("end", F.lit(0.0)).alias("e"), F.length(F.coalesce("text", F.lit(""))).cast("bigint").alias("n"))
    calls = base.groupBy("call_id").agg(F.min_by("a", "pos").alias("first"), F.max_by("e", "pos").alias("last"), F.sum("n").alias("total"), F.min("pos").alias("at"))
    calls = calls.filter((F.col("last") - F.col("first") >= 1.5 * target) | (F.col("total") >= max_chars))
    line = running(base.join(calls.select("call_id"), "call_id", "left_semi"), "call_id", "pos", sums={"row": F.lit(1), "chars": F.col("n")}, maxima={"top_a": F.col("a"), "top_e": F.col("e")}, before={"_before": F.col("e")})
    line = settled(line.withColumn("split", F.when(F.col("a") - F.col("_before") >= min_pause, (F.col("a") + F.col("_before")) / 2)).drop("_before"))
    paused = line.filter("split IS NOT NULL").select("call_id", "split")
    known = settled(calls.join(paused.select("call_id", F.lit(True).alias("paused")).distinct(), "call_id", "left").withColumn("paused", F.coalesce("paused", F.lit(False))))
    line = settled(line.drop("split").join(known.select("call_id", "first", "last", "paused"), "call_id"))
    starts = chain(settled(next_chunks(line, paused, target, max_chars)), known.select("call_id", "at"), "call_id")
    marked = segments.join(starts.select("call_id", F.col("at").alias("pos"), F.col("hop").alias("_hop")), ["call_id", "pos"], "left").select(*segments.columns, F.coalesce("_hop", F.lit(0)).alias("_hop"))
    return running(marked, "call_id", "pos", maxima={"chunk_id": F.col("_hop")}).withColumn("chunk_id", F.col("chunk_id").cast("int")).drop("_hop")


def chunks(segments: DataFrame, **limits) -> DataFrame:
    """One row for each chunk: times, text, characters and sorted speakers."""
    text = strip(F.coalesce("text", F.lit("")))
    parts = chunk_ids(segments, **limits).groupBy("call_id", "chunk_id").agg(
        F.min("pos").alias("first_pos"),
        F.min_by("start", "pos").alias("start_time"),
        F.max_by("end", "pos").alias("end_time"),
        F.sum(F.length(F.coalesce("text", F.lit("")))).cast("bigint").alias("char_count"),
        F.count("*").alias("segments"),
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", text.alias("t")))), lambda x: x["t"]), " ").alias("text"),
        F.sort_array(F.collect_set(F.nullif(F.col("speaker"), F.lit("")))).alias("speaker_labels"),
    )
    return parts


def turn_sections(segments: DataFrame) -> DataFrame:
    """``segments`` with ``section``: a new one whenever a non-empty speaker differs from the last non-empty one."""
    named = segments.withColumn("_s", F.nullif(F.col("speaker"), F.lit("")))
    before = F.last("_s", ignorenulls=True).over(in_call().rowsBetween(Window.unboundedPreceding, -1))
    changed = named.withColumn("_new", (F.col("_s").isNotNull() & (before.isNull() | (before != F.col("_s")))).cast("int"))
    return changed.withColumn("section", F.sum("_new").over(in_call()).cast("bigint")).drop("_s", "_new")


def latest_per_key(rows: DataFrame, key: str, order: str, most: int = 50) -> DataFrame:
    """The latest ``most`` rows of each key; the cut happens before the shuffle as well."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(order)))).filter(F.col("_n") <= most).drop("_n")


def recent_evidence(evidence: DataFrame, as_of: str, days: int = 90) -> DataFrame:
    """Evidence younger than ``days``; rows whose time can't be read stay."""
    at = F.try_to_timestamp("created_at")
    return evidence.filter(at.isNull() | (at >= F.lit(as_of).cast("timestamp") - F.expr(f"INTERVAL {int(days)} DAYS")))


def usage_rate(log: DataFrame, key: str, seconds: float, order: str = "timestamp") -> DataFrame:
    """``log`` with ``in_window``: records of the key in the trailing window that ends at each record."""
    frame = Window.partitionBy(key).orderBy(order).rangeBetween(-seconds, 0)
    return log.withColumn("in_window", F.count("*").over(frame))


def rate_schedule(requests: DataFrame, key: str, at: str, tie: str, most: int = 40, window: float = 60.0, margin: float = 0.1, block: float = 3600.0) -> DataFrame:
    """``requests`` with ``granted``, the time at which a limiter of ``most`` requests in ``window`` seconds lets each pass, and ``wait``.

    Requests of a key are served in order of ``at`` (ties by ``tie``). One waits until the one ``most`` places before it is ``window + margin`` seconds old:
    granted(i) = max(at(i), granted(i - most) + window + margin). Within the places that leave the same rest, this is a running maximum of ``at`` minus so many seconds a place, so that a key
    of any number of requests is dealt to blocks (of ``block`` seconds for the places, then of places).
    """
    placed = running(requests, key, at, sums={"_row": F.lit(1)}, block=block, tie=tie)
    lap = F.floor((F.col("_row") - 1) / most)
    placed = placed.withColumns({"_lane": F.struct(F.col(key).alias("k"), F.pmod(F.col("_row") - 1, F.lit(most)).alias("r")), "_lap": lap})
    later = F.lit(window + margin) * F.col("_lap")
    found = running(placed, "_lane", "_lap", maxima={"_free": F.col(at) - later})
    return found.withColumn("granted", F.col("_free") + later).withColumn("wait", F.greatest(F.lit(0.0), F.col("granted") - F.col(at))).select(*requests.columns, "granted", "wait")


def speaker_ranks(speakers: DataFrame, palette: int = 10) -> DataFrame:
    """``speakers`` with a colour number by sorted speaker inside the call."""
    return speakers.withColumn("colour", ((F.dense_rank().over(Window.partitionBy("call_id").orderBy("speaker")) - 1) % palette).cast("int"))


def pause_sessions(segments: DataFrame, min_pause: float = 3.0) -> DataFrame:
    """``segments`` with ``session``: counts gaps of at least ``min_pause`` so far."""
    new = F.coalesce((F.col("start") - F.lag("end").over(in_call("start")) >= min_pause).cast("int"), F.lit(0))
    return segments.withColumn("_new", new).withColumn("session", F.sum("_new").over(in_call("start").rowsBetween(Window.unboundedPreceding, 0)).cast("bigint")).drop("_new")

