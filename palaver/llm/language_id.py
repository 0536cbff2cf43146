"""Operator 10: language identification by rank-order n-gram profiles.

A language's profile is the ranking of its most frequent character n-grams (one to three letters, with word
borders) over all training texts. A document's own ranking is compared with each profile by out-of-place
distance: the sum of rank differences, with the largest difference for n-grams that the profile lacks.

Defined cases: a null text, or one without a letter, is ``und`` with score 0; without any training row every text
is ``und``; equal distances go to the language that sorts first; equal counts rank by the n-gram itself;
repeated rows get equal results; training rows with a null language or text teach nothing.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palaver.llm.common import crc_mod, fresh, slices

#: Length of a profile, and n-grams of a document that are ranked.
PROFILE = 300
#: Languages whose profiles are sent to the executors; more is an error, never a cut.
MOST_LANGUAGES = 5000
BORDER = 0x20
UNKNOWN = "und"


@cache
def letters() -> np.ndarray:
    """For every code point, whether it is a letter."""
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def code_points(text: bytes) -> np.ndarray:
    """Lower-cased letters of a text with one border between words and at both ends; empty without letters."""
    lowered = text.decode("utf-8", "replace").lower()
    codes = np.frombuffer(lowered.encode("utf-32-le", "surrogatepass"), np.uint32)
    keep = letters()[codes]
    if not keep.any():
        return np.zeros(0, np.uint64)
    codes = np.where(keep, codes, BORDER).astype(np.uint64)
    return np.concatenate([[BORDER], codes[keep | np.concatenate([[False], keep[:-1]])], [] if not keep[-1] else [BORDER]]).astype(np.uint64)


def grams(codes: np.ndarray) -> np.ndarray:
    """All n-grams of one to three places, packed 21 bits a place; a border only at an end, never alone."""
    inner = codes != BORDER
    one = codes[inner]
    two = (codes[:-1] << np.uint64(21)) | codes[1:]
    three = ((two[:-1] << np.uint64(21)) | codes[2:])[inner[1:-1]]
    return np.concatenate([one, two, three]).view(np.int64)


def counted(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    values = np.sort(values)
    new = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]])) if len(values) else np.zeros(0, np.int64)
    return values[new], np.diff(np.concatenate([new, [len(values)]]))


#: Bytes of texts whose n-grams are held at once.
SLICE = 1 << 19


def gram_counts(training: DataFrame, text_col: str, lang_col: str) -> DataFrame:
    """(lang, gram, n) over all training texts; each task sums its slices before the shuffle."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            langs = batch.column(1).to_pylist()
            for first, texts in slices((x.as_py() for x in batch.column(0)), SLICE):
                found: dict[str, list[np.ndarray]] = {}
                for lang, text in zip(langs[first : first + len(texts)], texts, strict=True):
                    if len(codes := code_points(text)):
                        found.setdefault(lang, []).append(grams(codes))
                for lang, parts in found.items():
                    keys, n = counted(np.concatenate(parts))
                    if lang in held:
                        keys, where = np.unique(np.concatenate([held[lang][0], keys]), return_inverse=True)
                        n = np.bincount(where, np.concatenate([held[lang][1], n])).astype(np.int64)
                    held[lang] = (keys, n)
            if sum(len(k) for k, _ in held.values()) > 2_000_000:
                yield from emit(held)
                held = {}
        yield from emit(held)

    def emit(held: dict) -> Iterator[pa.RecordBatch]:
        for lang, (keys, n) in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(keys), pa.string()), pa.array(keys), pa.array(n.astype(np.int64))], ["lang", "gram", "n"])

    rows = training.select(F.col(text_col).cast("binary"), F.col(lang_col).cast("string"))
    return rows.mapInArrow(count, "lang string, gram bigint, n bigint").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def learn_profiles(training: DataFrame, text_col: str = "text", lang_col: str = "lang", size: int = PROFILE) -> dict[str, np.ndarray]:
    """The ``size`` most frequent n-grams of every language, in order; the top is cut on the executors before the shuffle."""
    known = training.filter(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))
    top = gram_counts(known, text_col, lang_col).withColumn("rank", rank).filter(F.col("rank") <= size)
    rows = top.limit(MOST_LANGUAGES * size + 1).collect()
    if len(rows) > MOST_LANGUAGES * size:
        raise ValueError(f"more than {MOST_LANGUAGES} languages in the training rows")
    profiles: dict[str, list[tuple[int, int]]] = {}
    for row in rows:
        profiles.setdefault(row.lang, []).append((row["rank"], row.gram))
    return {lang: np.array([g for _, g in sorted(ranked)], np.int64) for lang, ranked in sorted(profiles.items())}


def predict_column(text: Column, profiles: dict[str, np.ndarray], size: int = PROFILE) -> Column:
    """struct(lang, score): the nearest profile, and one minus its distance over the largest distance possible."""
    names = list(profiles)
    union = np.unique(np.concatenate([np.zeros(0, np.int64), *profiles.values()]))
    ranks = np.full((len(names), len(union)), -1, np.int32)
    for i, lang in enumerate(names):
        ranks[i, np.searchsorted(union, profiles[lang])] = np.arange(len(profiles[lang]))

    def judge(text: bytes) -> tuple[str, float]:
        codes = code_points(text)
        if not len(codes) or not names:
            return UNKNOWN, 0.0
        keys, n = counted(grams(codes))
        top = keys[np.lexsort((keys, -n))[:size]]
        at = np.minimum(np.searchsorted(union, top), len(union) - 1)
        there = ranks[:, at]
        apart = np.where((there >= 0) & (union[at] == top), np.abs(there - np.arange(len(top))), size)
        total = np.minimum(apart, size).sum(axis=1)
        best = int(np.argmin(total))
        return names[best], float(1 - total[best] / (size * len(top)))

    @F.arrow_udf("struct<lang:string,score:double>")
    def predict(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            found = [judge(t) for _, part in slices(x.as_py() for x in batch) for t in part]
            yield pa.StructArray.from_arrays([pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64())], ["lang", "score"])

    return predict(text.cast("binary"))


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", folds: int = 4, held: int = 2) -> DataFrame:
    """Language and score of every text; learns from rows whose crc32 of the id is not ``held`` modulo ``folds``."""
    fold = crc_mod(id_col, folds)
    profiles = learn_profiles(docs.filter(fold != held), text_col, lang_col)
    found = docs.select(F.col(id_col).alias("doc_id"), (fold == held).alias("held_out"), predict_column(F.col(text_col), profiles).alias("_p"))
    return found.select("doc_id", "held_out", F.col("_p.lang").alias("lang_pred"), F.col("_p.score").alias("score"))


def keep_identified(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", folds: int = 4, held: int = 2, least: float = 0.0) -> DataFrame:
    """The rows whose text has a language, with score ``least`` or more; all columns stay."""
    profiles = learn_profiles(docs.filter(crc_mod(id_col, folds) != held), text_col, lang_col)
    name = fresh(docs, "_language")
    judged = docs.withColumn(name, predict_column(F.col(text_col), profiles))
    return judged.filter((F.col(f"{name}.lang") != UNKNOWN) & (F.col(f"{name}.score") >= least)).drop(name)
