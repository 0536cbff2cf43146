"""Name hints: regular expressions over segments, validity, deduplication and routing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Fixed values, in order: pattern, its name, confidence, whether the hint names the speaker.
PATTERNS = [
    (r"(?i)(?:this is|my name is)\s+([A-Z][a-z]{1,14})", "self_intro", 0.7, True),
    (r"(?i)(?:i'm|i am)\s+([A-Z][a-z]{1,14})\s+from", "self_intro_org", 0.7, True),
    (r"(?i)(?:hey|hi|hello)\s+([A-Z][a-z]{1,14})(?:\s|,|\.|\!)", "greeting", 0.5, False),
    (r"(?i)(?:thanks|thank you)\s+([A-Z][a-z]{1,14})(?:\s|,|\.|\!|$)", "thanks", 0.5, False),
    (r"(?i)(?:i'm|i am)\s+([A-Z][a-z]{1,14})(?:\s|,|\.|\!|$)", "self_announce", 0.6, True),
    (r"([A-Z][a-z]{1,14})\s+here(?:\s|,|\.|\!|$)", "here_announce", 0.5, True),
    (r"(?:right|so|well|okay)\s+([A-Z][a-z]{1,14})(?:\s|,)", "mid_address", 0.4, False),
]
#: Capitalised words that are no names.
NO_NAMES = (
    "Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday",
    "January", "February", "March", "April", "May", "June", "July", "August", "September", "October", "November", "December",
    "Thanks", "Thank", "Hello", "Yeah", "Yes", "Right", "Well", "Actually", "Basically", "Sure", "Okay", "Sorry", "Please",
    "Google", "Microsoft", "Amazon", "Apple", "Facebook", "Netflix", "The", "This", "That", "What", "Where", "When", "How",
)


def valid_name(name: Column) -> Column:
    """2 to 15 letters, the first a capital, and none of the words that are no names."""
    return F.length(name).between(2, 15) & ~name.isin(*NO_NAMES) & F.rlike(name, F.lit(r"^\p{Lu}\p{L}*$"))


def name_hints(segments: DataFrame) -> DataFrame:
    """(call_id, pos, name, speaker, timestamp, pattern, confidence): the first hint of each (name, speaker) of a call."""
    found = F.array(*[
        F.struct(F.lit(i).alias("order"), F.lit(name).alias("pattern"), F.lit(score).alias("confidence"), F.regexp_extract_all("text", F.lit(regex), F.lit(1)).alias("names"))
        for i, (regex, name, score, _) in enumerate(PATTERNS)
    ])
    rows = segments.filter("text IS NOT NULL").select("call_id", "pos", F.coalesce("speaker", F.lit("")).alias("speaker"), F.col("start").alias("timestamp"), F.explode(found).alias("f"))
    rows = rows.filter(F.size("f.names") > 0).select("call_id", "pos", "speaker", "timestamp", "f.order", "f.pattern", "f.confidence", F.posexplode("f.names").alias("match", "name"))
    valid = rows.filter(valid_name(F.col("name")))
    first = Window.partitionBy("call_id", F.lower("name"), "speaker").orderBy("pos", "order", "match")
    return valid.withColumn("_n", F.row_number().over(first)).filter("_n = 1").select("call_id", "pos", "name", "speaker", "timestamp", "pattern", "confidence")


def ranked_hints(hints: DataFrame) -> DataFrame:
    """``hints`` with ``rank``: from 1 in each call, the most confident first, then in order of the transcript."""
    return hints.withColumn("rank", F.row_number().over(Window.partitionBy("call_id").orderBy(F.desc("confidence"), "pos", "pattern", "name", "speaker")))


def routed_hints(hints: DataFrame) -> DataFrame:
    """``hints`` with ``target``: the speaker for introductions, else ``addressed_by_`` and the speaker."""
    own = F.col("pattern").isin([name for _, name, _, mine in PATTERNS if mine])
    return hints.withColumn("target", F.when(own, F.col("speaker")).otherwise(F.concat(F.lit("addressed_by_"), F.col("speaker"))))
