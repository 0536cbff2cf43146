"""Scalar functions over columns; all run in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WORD = r"[\p{L}\p{N}_]+"
NOT_BLANK = r"\S+"


def strip(text: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(F.regexp_replace(text, r"^\s+", ""), r"\s+$", "")


def word_count(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(NOT_BLANK)).cast("bigint")


def tokens(text: Column) -> Column:
    """Lower-cased runs of letters, digits and underscores."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(WORD), F.lit(0))


def ngrams(words: Column, n: int) -> Column:
    """All runs of ``n`` words, repeats included, joined by spaces; none if there are fewer."""
    rest = F.greatest(F.size(words) - n + 1, F.lit(0))
    some = F.slice(words, F.lit(1), rest)
    for k in range(1, n):
        some = F.zip_with(some, F.slice(words, F.lit(k + 1), rest), lambda a, b: F.concat(a, F.lit(" "), b))
    return F.when(F.size(words) >= n, some).otherwise(F.array().cast("array<string>"))


def snippet(text: Column, query: Column, around: int = 80, bare: int = 160) -> Column:
    """The first hit with ``around`` characters on each side, dots where text was cut; without a hit the first ``bare`` characters."""
    at = F.instr(F.lower(text), F.lower(query))
    length = F.length(query)
    begin = F.greatest(F.lit(1), at - around)
    stop = F.least(F.length(text), at + length - 1 + around)
    cut = strip(F.substring(text, begin, stop - begin + 1))
    hit = F.concat(F.when(begin > 1, F.lit("...")).otherwise(F.lit("")), cut, F.when(stop < F.length(text), F.lit("...")).otherwise(F.lit("")))
    return F.when((length == 0) | (at == 0), strip(F.substring(text, 1, bare))).otherwise(hit)


def padded(x: Column, n: int = 2) -> Column:
    """At least ``n`` digits; ``lpad`` alone would cut longer numbers."""
    digits = x.cast("string")
    return F.when(F.length(digits) < n, F.lpad(digits, n, "0")).otherwise(digits)


def whole(seconds: Column) -> Column:
    return F.floor(seconds).cast("bigint")


def clock(seconds: Column) -> Column:
    """``HH:MM:SS``, or ``MM:SS`` below an hour."""
    s = whole(seconds)
    minutes = lambda x: F.concat(padded((x / 60).cast("bigint")), F.lit(":"), padded(x % 60))
    return F.when(s >= 3600, F.concat(padded((s / 3600).cast("bigint")), F.lit(":"), minutes(s % 3600))).otherwise(minutes(s))


def minutes_clock(seconds: Column) -> Column:
    """``MM:SS`` with unbounded minutes."""
    s = whole(seconds)
    return F.concat(padded((s / 60).cast("bigint")), F.lit(":"), padded(s % 60))


def human_duration(seconds: Column) -> Column:
    """``1h 2m 3s``; leading zero parts are left out."""
    s = whole(seconds)
    h, m, rest = F.floor(s / 3600).cast("bigint"), F.floor(s % 3600 / 60).cast("bigint"), s % 60
    part = lambda x, unit: F.concat(x.cast("string"), F.lit(unit))
    return F.when(h > 0, F.concat_ws(" ", part(h, "h"), part(m, "m"), part(rest, "s"))).when(m > 0, F.concat_ws(" ", part(m, "m"), part(rest, "s"))).otherwise(part(s, "s"))


def human_size(size: Column) -> Column:
    """``500 B``, ``1.5 KB`` and so on up to TB."""
    one = lambda x: F.format_string("%.1f", F.bround(x, 1))  # noqa: E731  a half goes to the even digit
    out = F.concat(one(size / 1024.0**4), F.lit(" TB"))
    for power, unit in ((3, "GB"), (2, "MB"), (1, "KB")):
        out = F.when(size < 1024.0 ** (power + 1), F.concat(one(size / 1024.0**power), F.lit(f" {unit}"))).otherwise(out)
    return F.when(size < 1024, F.concat(size.cast("bigint").cast("string"), F.lit(" B"))).otherwise(out)


def first_words(text: Column, n: int = 25) -> Column:
    """The text as it is if it has at most ``n`` words, else the first ``n`` of them and ``...``."""
    words = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(NOT_BLANK), F.lit(0))
    return F.when(F.size(words) > n, F.concat(F.array_join(F.slice(words, 1, n), " "), F.lit("..."))).otherwise(F.coalesce(text, F.lit("")))


def content_hash(content: Column) -> Column:
    return F.sha2(content, 256)


def confidence(stored: Column, avg_logprob: Column) -> Column:
    """The stored value, else exp of the mean log probability between 0 and 1, else null."""
    return F.coalesce(stored, F.when(avg_logprob.isNotNull(), F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.exp(avg_logprob)))))


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two vectors; 0 if either is empty, has no length, or lengths differ."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when((F.size(a) == F.size(b)) & (F.size(a) > 0) & (norm > 0), dot(a, b) / norm).otherwise(F.lit(0.0))


#: Score from which a match counts, best first.
BANDS = ((0.92, "confirmed"), (0.80, "probable"), (0.60, "candidate"))


def band(score: Column, bands: tuple = BANDS, rest: str = "unknown") -> Column:
    out = F.lit(rest)
    for least, name in reversed(bands):
        out = F.when(score >= least, F.lit(name)).otherwise(out)
    return out


def status_rank(status: Column) -> Column:
    """unknown < candidate < probable < confirmed as 0 to 3."""
    return F.when(status == "confirmed", 3).when(status == "probable", 2).when(status == "candidate", 1).otherwise(0)


def llm_cost(input_tokens: Column, output_tokens: Column, input_price: Column, output_price: Column) -> Column:
    """US dollars for tokens at prices per million."""
    return (input_tokens * input_price + output_tokens * output_price) / F.lit(1_000_000.0)


def review_priority(seconds: Column, calls: Column, samples: Column) -> Column:
    """Weighted urgency of naming a speaker, three decimals."""
    one = F.lit(1.0)
    return F.round(0.35 * F.least(one, seconds / 60 / 120) + 0.25 * F.least(one, calls / 20) + 0.20 * 0.5 + 0.20 * F.least(one, samples / 10), 3)


def review_reason(seconds: Column, calls: Column) -> Column:
    return F.when(calls >= 5, F.lit("frequent_unknown_speaker")).when(seconds >= 600, F.lit("high_speaking_time")).otherwise(F.lit("new_unknown_speaker"))


def slug(tag: Column) -> Column:
    return F.replace(F.lower(tag), F.lit(" "), F.lit("-"))


def day_of(created: Column, modified: Column, today: Column) -> Column:
    """The first ten characters of the first date there is."""
    return F.substring(F.coalesce(F.nullif(created, F.lit("")), F.nullif(modified, F.lit("")), today), 1, 10)


def number_list(text: Column) -> Column:
    """Comma-separated numbers as an array; what is no number is left out."""
    return F.array_compact(F.transform(F.split(text, ","), lambda x: strip(x).try_cast("double")))


def fenced_json(text: Column, schema: str) -> Column:
    """JSON inside an optional code fence, parsed; null if it is none."""
    bare = F.regexp_replace(F.regexp_replace(strip(text), r"^```[A-Za-z]*\s*", ""), r"\s*```$", "")
    return F.from_json(bare, schema, {"mode": "PERMISSIVE"})


def truncated(text: Column, most: int = 100_000, mark: str = "\n\n[TRANSCRIPT TRUNCATED]") -> Column:
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most), F.lit(mark))).otherwise(text)


def cut_dots(text: Column, most: int = 200) -> Column:
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most), F.lit("..."))).otherwise(text)


def stable_id(prefix: str, digits: int, *parts: Column) -> Column:
    """A reproducible identifier from the parts that name the thing."""
    return F.concat(F.lit(prefix), F.substring(F.sha2(F.concat_ws(":", *parts), 256), 1, digits))


def redacted(text: Column, secret: Column) -> Column:
    return F.when(F.coalesce(F.length(secret), F.lit(0)) > 0, F.replace(text, secret, F.lit("***"))).otherwise(text)


def display_name(name: Column, aliases: Column, cluster: Column) -> Column:
    return F.coalesce(F.nullif(name, F.lit("")), F.get(aliases, F.lit(0)), cluster)


def deep_get(document: Column, path: str, default: str | None = None) -> Column:
    """A value inside JSON text by dotted path, with a default."""
    return F.coalesce(F.get_json_object(document, "$." + path), F.lit(default).cast("string"))
