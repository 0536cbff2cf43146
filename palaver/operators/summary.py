"""Extractive summaries: the sentences of a text that rank highest in the graph of sentences by shared words."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palaver.functions.scalars import strip, tokens

#: Texts that a task ranks at a time.
TEXTS = 256


def sentences(text: Column) -> Column:
    """Parts that end with a full stop, a question or an exclamation mark before white space; blank ones are left out."""
    return F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), r"(?<=[.!?])\s+"), strip), lambda s: s != "")


def sentence_scores(damping: float, rounds: int, tolerance: float):
    """Function from texts, each a list of its sentences' distinct words, to the scores of their sentences."""

    def of(texts: pa.ListArray) -> pa.ListArray:
        said = texts.flatten()
        n = pc.list_value_length(texts).to_numpy().astype(np.int64)
        text = np.repeat(np.arange(len(n)), n)
        words = pc.list_value_length(said).to_numpy().astype(np.int64)
        at = np.repeat(np.arange(len(words)), words)
        code = said.flatten().dictionary_encode().indices.to_numpy().astype(np.int64)
        _, word = np.unique(text[at] * (code.max(initial=0) + 1) + code, return_inverse=True)
        w = 1 / np.sqrt(words[at])
        by_word = lambda x: np.bincount(word, x, 1)[word]
        by_sentence = lambda x: np.bincount(at, x, len(words))
        # What a sentence shares with all others, over all its words: the sum of the others' weights.
        out = by_sentence(w * (by_word(w) - w))
        score = 1 / n[text]
        live = np.ones(len(n), bool)
        for _ in range(rounds):
            x = np.divide(score, out, out=np.zeros(len(score)), where=out > 1e-12)
            # A sentence's words have the weight one together, so its own share is what it gives.
            new = (1 - damping) / n[text] + damping * np.maximum(0.0, by_sentence(w * by_word(w * x[at])) - x)
            new = np.where(live[text], new, score)
            live &= np.bincount(text, np.abs(new - score), len(n)) > (tolerance or -1.0)
            score = new
            if not live.any():
                break
        return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]).astype(np.int32)), pa.array(score))

    return of


def ranked_sentences(docs: DataFrame, key: str, text: str, damping: float = 0.85, rounds: int = 20, tolerance: float = 1e-6) -> DataFrame:
    """(key, pos, sentence, score): scores of the sentences of each text, which add up to at most one.

    Two sentences are as alike as their sets of words (cosine), and a sentence hands its score on to those it is like, in proportion. This matrix of sentences is never formed: it is that of
    sentences by words times its transpose, so a round is a sum by word and a sum by sentence, and a word that all sentences share costs as many cells as it has sentences, not their square.
    A text ends after ``rounds`` rounds, or when no more than ``tolerance`` moves in it. Texts are rows, and a text is ranked where it lies, some at a time: nothing is shuffled or stored.
    A key is expected once; rows with the same key are texts of their own.
    """
    score = sentence_scores(damping, rounds, tolerance)

    @F.arrow_udf("array<double>")
    def scores(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.concat_arrays([pa.array([], pa.list_(pa.float64())), *[score(batch.slice(at, TEXTS)) for at in range(0, len(batch), TEXTS)]])

    words = F.transform("_s", lambda s: F.array_distinct(tokens(s)))
    listed = docs.select(F.col(key).alias("_key"), sentences(F.col(text)).alias("_s")).filter(F.size("_s") > 0)
    scored = listed.select("_key", "_s", scores(words).alias("_x"))
    return scored.select(F.col("_key").alias(key), F.posexplode(F.arrays_zip("_s", "_x")).alias("pos", "_z")).select(key, "pos", F.col("_z._s").alias("sentence"), F.col("_z._x").alias("score"))


def extractive_summary(docs: DataFrame, key: str = "call_id", text: str = "text", most: int = 3, **how) -> DataFrame:
    """(key, summary, sentences): the ``most`` highest sentences of each text in their order; of equal scores (nine decimals) the earlier one. A text without sentences has no row."""
    w = Window.partitionBy(key).orderBy(F.desc(F.round("score", 9)), "pos")
    top = ranked_sentences(docs, key, text, **how).withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= most)
    chosen = top.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("pos", "sentence"))).alias("s"))
    return chosen.select(key, F.array_join(F.col("s.sentence"), " ").alias("summary"), F.col("s.pos").alias("sentences"))
