"""Quality flags of segments and audio."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palaver.functions.scalars import confidence
from palaver.operators.scan import running
from palaver.operators.sequence import repetition_flags

#: Names of the risk by number of flags.
RISKS = ("none", "low", "medium", "high")


def flag_segments(segments: DataFrame, min_confidence: float | None = None, threshold: float = 0.6, energy: str | None = None) -> DataFrame:
    """``segments`` with confidence, flags and risk.

    Three flags: confidence below the minimum (no minimum, or zero, means 0.4), repetition of the segment before, and low energy
    (a boolean column named by ``energy``; without one there is no audio and the flag is off).
    """
    least = min_confidence or 0.4
    scored = repetition_flags(segments, threshold).withColumn("confidence", confidence(F.col("confidence"), F.col("avg_logprob")))
    low = F.coalesce(F.col(energy), F.lit(False)) if energy else F.lit(False)
    flags = F.array_compact(F.array(F.when(F.col("confidence") < least, F.lit("low_confidence")), F.when(F.col("repeated"), F.lit("repetition")), F.when(low, F.lit("low_energy"))))
    return scored.withColumn("flags", flags).withColumn("risk", risk_of(F.size("flags"))).drop("repeated")


def risk_of(flags: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, RISKS)), flags + 1)


def apply_filter(flagged: DataFrame, mode: str = "auto") -> DataFrame:
    """``auto`` drops segments of high risk; ``flag`` and ``off`` keep all."""
    return flagged.filter(F.col("risk") != "high") if mode == "auto" else flagged


def quality_summary(flagged: DataFrame) -> DataFrame:
    """Per call: mean confidence of segments that have one, and how many are at medium or high risk."""
    return flagged.groupBy("call_id").agg(F.avg("confidence").alias("confidence"), F.count_if(F.col("risk").isin("medium", "high")).alias("hallucination_flags"))


def segment_energy(audio: DataFrame, rate: int = 16_000, least: float = 0.01, max_seconds: float = 1800.0) -> DataFrame:
    """(call_id, pos, low_energy) from rows with (call_id, pos, start, end, duration_seconds, samples of the segment).

    True if the root mean square is below ``least`` or there are no samples; false for recordings over ``max_seconds``, which are not judged.
    """
    rms = F.round(F.sqrt(F.aggregate("samples", F.lit(0.0), lambda s, x: s + x * x) / F.size("samples")), 9)
    low = F.when(F.col("duration_seconds") > max_seconds, F.lit(False)).otherwise(F.coalesce((F.size("samples") <= 0) | (rms < least), F.lit(True)))
    return audio.select("call_id", "pos", low.alias("low_energy"))


def sample_blocks(audio: DataFrame, size: int = 16_384) -> DataFrame:
    """(call_id, block, samples): whole recordings (call_id, samples) cut into blocks of ``size`` samples; a reader of large files yields such blocks itself."""
    starts = F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor((F.size("samples") - 1) / size).cast("int")))
    return audio.filter(F.size("samples") > 0).select("call_id", F.explode(starts).alias("block"), "samples").select("call_id", "block", F.slice("samples", F.col("block") * size + 1, F.lit(size)).alias("samples"))


def recording_energy(recordings: DataFrame, blocks: DataFrame, segments: DataFrame, size: int = 16_384, least: float = 0.01, max_seconds: float = 1800.0) -> DataFrame:
    """(call_id, pos, rms, low_energy) of segments (call_id, pos, start, end) within whole recordings.

    recordings: (call_id, rate, samples: their number, bytes: of the file or null); blocks: (call_id, block, samples), ``size`` samples each but the last. The squares up to a sample are the sum over the blocks before its own,
    which is a running sum, and over a part of its own block; a segment's energy is the difference of two such numbers, so no task holds a recording and a long segment costs no more than a short one.
    A segment without samples in the recording is low. Recordings over ``max_seconds``, or with files of more than 25,000 bytes for each of these, are not judged (false, without a value), and neither are calls without a recording.
    """
    square = lambda xs: F.aggregate(xs, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    judged = (F.col("samples") / F.col("rate") <= max_seconds) & (F.coalesce("bytes", F.lit(0)) <= max_seconds * 25_000)
    asked = segments.join(recordings.select("call_id", "rate", F.col("samples").alias("_n"), judged.alias("_judged")), "call_id", "left")
    sample = lambda t: F.floor(F.coalesce(t, F.lit(0.0)) * F.col("rate")).cast("bigint")
    asked = asked.select("call_id", "pos", F.coalesce("_judged", F.lit(False)).alias("_judged"), F.greatest(F.lit(0), sample(F.col("start"))).alias("_a"), F.least(sample(F.col("end")), "_n").alias("_b"))
    ends = asked.filter(F.col("_judged") & (F.col("_a") < F.col("_b"))).select("call_id", "pos", F.explode(F.array(F.struct(F.col("_a").alias("at"), F.lit(-1).alias("sign")), F.struct(F.col("_b").alias("at"), F.lit(1).alias("sign")))).alias("e")).select("call_id", "pos", "e.*")
    sums = running(blocks.select("call_id", "block", square(F.col("samples")).alias("_e")), "call_id", "block", sums={"_upto": F.col("_e")})
    known = sums.select("call_id", "block", (F.col("_upto") - F.col("_e")).alias("_before")).join(blocks, ["call_id", "block"])
    # The last sample of a block is looked up in it, not at the start of the next one, which may not be there.
    placed = ends.withColumn("block", F.when(F.col("at") == 0, F.lit(0)).otherwise(F.floor((F.col("at") - 1) / size)).cast("int"))
    upto = placed.join(known, ["call_id", "block"]).select("call_id", "pos", "sign", (F.col("_before") + square(F.slice("samples", F.lit(1), (F.col("at") - F.col("block") * size).cast("int")))).alias("v"))
    energy = upto.groupBy("call_id", "pos").agg(F.sum(F.col("sign") * F.col("v")).alias("_energy"))
    rms = F.sqrt(F.when(F.col("_energy").isNotNull(), F.greatest(F.lit(0.0), F.col("_energy"))) / F.nullif(F.col("_b") - F.col("_a"), F.lit(0)))
    return asked.join(energy, ["call_id", "pos"], "left").select("call_id", "pos", rms.alias("rms"), F.when(~F.col("_judged"), False).otherwise(F.coalesce(F.round(rms, 9) < least, F.lit(True))).alias("low_energy"))


def snr_db(samples: np.ndarray, rate: int) -> float:
    """Ratio in dB of the loudest to the quietest tenth of 25 ms frames (every 10 ms); 0 below ten frames."""
    size, hop = int(0.025 * rate), int(0.010 * rate)
    if len(samples) < size or size < 1 or hop < 1:
        return 0.0
    frames = np.lib.stride_tricks.sliding_window_view(samples, size)[::hop]
    if len(frames) < 10:
        return 0.0
    rms = np.sort(np.sqrt((frames**2).mean(axis=1)))
    tenth = max(1, len(rms) // 10)
    noise, signal = rms[:tenth].mean(), rms[-tenth:].mean()
    return float(20 * np.log10(signal / noise)) if noise > 0 and signal > 0 else 0.0


def compute_snr(audio: DataFrame, rate: int = 16_000) -> DataFrame:
    """(call_id, snr_db) from (call_id, samples); each recording is one row, so nothing is shuffled."""

    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            yield pd.DataFrame({"call_id": rows["call_id"], "snr_db": [snr_db(np.asarray(x if x is not None else [], float), rate) for x in rows["samples"]]})

    return audio.select("call_id", "samples").mapInPandas(judge, f"call_id {audio.schema['call_id'].dataType.simpleString()}, snr_db double")
