"""Operator 8: benchmark decontamination by a BM25 index with block-max pruning.

The benchmark items are the indexed texts and every passage of every training text is a query. Passages are windows
that overlap by half, long enough that any item lies wholly inside one. An item's impacts are divided by its own
threshold (a share of the score of the item itself), so every item is retrieved at a sum of one.

Pruning is exact. An item's least impacts, up to a sum of IDLE, are not essential: it can't reach one by them alone, so only
postings of essential terms open a candidate. Items lie in blocks; a block whose largest essential impacts plus the largest
rest of its items stay below one is skipped; the others are scored in full. Retrieved items are verified: the share of five-word shingles
of question and of answer that the passage has must reach the similarity. The answer is the item's last sentence if it has one, else
its last fifth; a part of under five words is verified as one run, and so is a whole item of under five words.

Defined cases: a null or empty text has no passages; an item without words never matches; items with
equal texts are all reported; repeated rows are judged alike; without items every row is kept; texts of any length are read whole; other columns stay as they are, whatever their names.
"""

from __future__ import annotations

import math
import string
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palaver.llm.common import LOWER, UPPER, fresh, slices

K1, B = 1.2, 0.75
#: Retrieval threshold as a share of an item's own score, and least share of shingles of question and of answer.
SHARE, SIMILARITY, SHINGLE = 0.6, 0.8, 5
BLOCK = 8
#: Largest sum of impacts, in thresholds, of an item's terms that open no candidate; any value below one is exact.
IDLE = 0.4
#: Bytes of benchmark text that one index holds; a larger benchmark is dealt to several, each scanned on its own.
INDEX_BYTES = 16 << 20
FOLD = bytes.maketrans(UPPER.encode() + string.punctuation.encode(), LOWER.encode() + b" " * len(string.punctuation))


def words(text: bytes) -> list[bytes]:
    """A to Z lower-cased, ASCII punctuation as white space, split at ASCII white space."""
    return text.translate(FOLD).split()


def parts(text: bytes) -> tuple[list[bytes], list[bytes]]:
    """Question and answer of an item; one of under five words is a question alone, to be found as one run."""
    every = words(text)
    if len(every) < SHINGLE:
        return every, []
    body = text.strip()
    at = max(body[:-1].rfind(mark) for mark in (b".", b"?", b"!", b"\n", b":"))
    question, answer = words(body[: at + 1]), words(body[at + 1 :])
    if not question or not answer:
        every = question + answer
        cut = len(every) - max(1, len(every) // 5)
        question, answer = every[:cut], every[cut:]
    return question, answer


def item_terms(benchmark: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(item_id, text, terms, idf): distinct terms of each item with their weight over the whole benchmark."""

    @F.arrow_udf("array<binary>")
    def distinct(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array([sorted(set(words(x.as_py() or b""))) for x in batch], pa.list_(pa.binary()))

    items = benchmark.select(F.col(id_col).cast("bigint").alias("item_id"), F.coalesce(F.col(text_col).cast("binary"), F.lit(b"")).alias("text")).distinct()
    total = items.count()
    pairs = items.withColumn("term", F.explode(distinct("text")))
    frequency = pairs.groupBy("term").agg(F.count("*").alias("df"))
    idf = F.log1p((F.lit(total) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weighed = pairs.join(frequency, "term").select("item_id", "text", F.struct("term", idf.alias("idf")).alias("t"))
    return weighed.groupBy("item_id", "text").agg(F.collect_list("t").alias("terms"))


@dataclass
class Index:
    """One inverted index for items of similar length; arrays by term are in the order of ``terms``."""

    reach: int  # largest number of words of its items
    terms: dict[bytes, int]
    starts: np.ndarray  # of each term's block postings
    blocks: np.ndarray
    maxima: np.ndarray  # largest essential impact in the block
    rest: np.ndarray  # of each block: largest sum of impacts that are not essential
    items: list[list[tuple[int, np.ndarray, np.ndarray, list, list]]]  # by block: id, terms, impacts, question, answer


def build(rows: list[tuple[int, bytes, list[tuple[bytes, float]]]], share: float) -> list[Index]:
    """Indexes by the power of two that an item's length reaches, so short items get short passages."""
    lengths = [len(words(text)) for _, text, _ in rows]
    mean = sum(lengths) / max(1, len(lengths))
    classes: dict[int, list[int]] = defaultdict(list)
    for i, n in enumerate(lengths):
        if n:
            classes[1 << (n - 1).bit_length()].append(i)
    found = []
    for reach, members in sorted(classes.items()):
        terms: dict[bytes, int] = {}
        postings: dict[int, dict[int, float]] = defaultdict(dict)
        blocks, rest = [], []
        for at in range(0, len(members), BLOCK):
            block, most = [], 0.0
            for i in members[at : at + BLOCK]:
                item, text, weights = rows[i]
                tf: dict[bytes, int] = defaultdict(int)
                for w in words(text):
                    tf[w] += 1
                norm = K1 * (1 - B + B * lengths[i] / mean)
                impact = sorted((idf * tf[t] * (K1 + 1) / (tf[t] + norm), t) for t, idf in weights)
                least = share * sum(x for x, _ in impact)
                ids = np.array([terms.setdefault(t, len(terms)) for _, t in impact], np.int64)
                scaled = np.array([x / least for x, _ in impact])
                idle = int(np.searchsorted(np.cumsum(scaled), IDLE, side="right"))  # the least impacts, up to a sum of IDLE
                most = max(most, float(scaled[:idle].sum()))
                for t, x in zip(ids[idle:].tolist(), scaled[idle:].tolist(), strict=True):
                    postings[t][len(blocks)] = max(x, postings[t].get(len(blocks), 0.0))
                block.append((item, ids, scaled, *parts(text)))
            blocks.append(block)
            rest.append(most)
        flat = [(b, x) for t in range(len(terms)) for b, x in sorted(postings[t].items())]
        starts = np.cumsum([0] + [len(postings[t]) for t in range(len(terms))])
        found.append(Index(reach, terms, starts, np.array([b for b, _ in flat], np.int64), np.array([x for _, x in flat]), np.array(rest), blocks))
    return found


def covered(part: list[bytes], passage: list[bytes], grams: set[bytes]) -> float:
    """Share of the shingles of ``part`` that the passage has."""
    if not part:
        return 1.0
    if len(part) < SHINGLE:
        return float(b" " + b" ".join(part) + b" " in b" " + b" ".join(passage) + b" ")
    own = {b" ".join(part[i : i + SHINGLE]) for i in range(len(part) - SHINGLE + 1)}
    return len(own & grams) / len(own)


def retrieve(index: Index, tokens: list[bytes], ends: np.ndarray, similarity: float) -> Iterator[tuple[int, int, float, float, float]]:
    """(text, item, score, question, answer) for the texts whose words stand in ``tokens`` up to ``ends``."""
    ids = np.fromiter(map(index.terms.get, tokens, repeat(-1)), np.int64, len(tokens))
    at = np.flatnonzero(ids >= 0)
    if not len(at):
        return
    ids = ids[at]
    text = np.searchsorted(ends, at, side="right")
    begin = np.concatenate([[0], ends[:-1]])[text]
    half = (at - begin) // index.reach  # the window that starts here, and the one before, hold the place
    windows = (text << 40) | half
    back = half > 0
    ids, windows = np.concatenate([ids, ids[back]]), np.concatenate([windows, windows[back] - 1])
    count = index.starts[ids + 1] - index.starts[ids]
    where = np.repeat(np.arange(len(ids)), count)
    if not len(where):
        return
    posting = np.arange(len(where)) - np.repeat(np.cumsum(count) - count, count) + index.starts[ids][where]
    # One entry for each window, block and term, then bounds by window and block.
    names, window_no = np.unique(windows, return_inverse=True)
    entry = (window_no[where] * len(index.items) + index.blocks[posting]) * len(index.terms) + ids[where]
    entry, first = np.unique(entry, return_index=True)
    pair, sums = entry // len(index.terms), index.maxima[posting[first]]
    pairs, begins = np.unique(pair, return_index=True)
    bound = np.add.reduceat(sums, begins) + index.rest[pairs % len(index.items)]
    for p in pairs[bound >= 1.0 - 1e-9].tolist():
        number, block = divmod(p, len(index.items))
        name = int(names[number])
        doc, start = name >> 40, (name & ((1 << 40) - 1)) * index.reach
        base = int(ends[doc - 1]) if doc else 0
        passage = tokens[base + start : min(base + start + 2 * index.reach, int(ends[doc]))]
        there = np.array(sorted({index.terms[t] for t in passage if t in index.terms}), np.int64)
        grams = None
        for item, terms, impacts, question, answer in index.items[block]:
            score = float(impacts[np.isin(terms, there)].sum())
            if score < 1.0 - 1e-9:
                continue
            if grams is None:
                grams = {b" ".join(passage[i : i + SHINGLE]) for i in range(len(passage) - SHINGLE + 1)}
            q, a = covered(question, passage, grams), covered(answer, passage, grams)
            if q >= similarity and a >= similarity:
                yield doc, item, score, q, a


def hits_column(text: Column, indexes, share: float, similarity: float) -> Column:
    """array<struct(item_id, score, question, answer)>: verified items of each text; scores are shares of an item's own."""

    @F.arrow_udf("array<struct<item_id:bigint,score:double,question:double,answer:double>>")
    def hits(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        kind = pa.list_(pa.struct([("item_id", pa.int64()), ("score", pa.float64()), ("question", pa.float64()), ("answer", pa.float64())]))
        for batch in batches:
            out: list[list[dict]] = []
            for _, texts in slices(x.as_py() for x in batch):
                tokens: list[bytes] = []
                ends = np.zeros(len(texts), np.int64)
                for i, t in enumerate(texts):
                    tokens += words(t)
                    ends[i] = len(tokens)
                best: list[dict[int, tuple]] = [{} for _ in texts]
                for index in indexes.value:
                    for doc, item, score, q, a in retrieve(index, tokens, ends, similarity):
                        best[doc][item] = max(best[doc].get(item, (0.0,)), (round(score * share, 9), q, a))
                out += [[{"item_id": k, "score": v[0], "question": v[1], "answer": v[2]} for k, v in sorted(found.items())] for found in best]
            yield pa.array(out, kind)

    return hits(text.cast("binary"))


def share_indexes(benchmark: DataFrame, id_col: str, text_col: str, share: float) -> list:
    """Broadcast indexes, each over at most about INDEX_BYTES of benchmark text; weights are those of the whole benchmark."""
    spark = benchmark.sparkSession
    size = benchmark.agg(F.coalesce(F.sum(F.octet_length(F.col(text_col))), F.lit(0))).first()[0]
    dealt = max(1, math.ceil(size / INDEX_BYTES))
    terms = item_terms(benchmark, id_col, text_col)
    found = []
    for part in range(dealt):
        mine = terms if dealt == 1 else terms.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(dealt)) == part)
        rows = [(r.item_id, bytes(r.text), [(bytes(t.term), t.idf) for t in r.terms]) for r in mine.collect()]
        found.append(spark.sparkContext.broadcast(build(sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1])), share)))
    return found


def with_hits(docs: DataFrame, benchmark: DataFrame, out: str, text_col: str, item_col: str, item_text: str, share: float, similarity: float) -> DataFrame:
    names = [hits_column(F.col(text_col), x, share, similarity) for x in share_indexes(benchmark, item_col, item_text, share)]
    return docs.withColumn(out, F.concat(*names) if len(names) > 1 else names[0])


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", share: float = SHARE, similarity: float = SIMILARITY) -> DataFrame:
    """(doc_id, item_id, score, question, answer): every benchmark item that a text contains."""
    narrow = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    found = with_hits(narrow, benchmark, "_hits", "text", item_col, item_text, share, similarity)
    return found.select("doc_id", F.explode("_hits").alias("h")).select("doc_id", "h.item_id", "h.score", "h.question", "h.answer")


def keep_clean(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text: str = "text", share: float = SHARE, similarity: float = SIMILARITY) -> DataFrame:
    """The rows that contain no benchmark item; all columns stay."""
    name = fresh(docs, "_hits")
    return with_hits(docs, benchmark, name, text_col, item_col, item_text, share, similarity).filter(F.size(name) == 0).drop(name)
