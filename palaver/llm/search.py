"""Operator 4: exact BM25 top-k by an inverted index with block-max WAND pruning, per shard, merged with global statistics.

The index is built once, in the tasks that read the texts, and stored: a shard holds the postings of texts of about ``SHARD_BYTES``, documents that share common words (those of a language, say) side by side, in the order of
their length, in blocks of ``BLOCK``. Document frequencies, number and mean length are those of all texts, so scores of different shards compare and the merge of the shards' best is the exact top.

Queries go out in blocks of bounded size. Shards are searched in rounds (``ROUNDS``): a query's k-th score so far is the threshold that the next round starts from, and
a task raises it from shard to shard. A shard has its common terms as a matrix of impacts, and several queries, such as have words in common, are asked at once. Terms before
the pivot are those of the matrix that enough of these queries have: they are never opened. Postings of all others are summed; a block is skipped if its largest sum
and its largest impacts of the query's terms before the pivot stay below the threshold, and a shard if all the query's largest impacts do. Blocks that are left get the terms before the pivot by a product of
queries and matrix in 32 bits, whose error is bounded; the documents that can still reach the threshold, or be among the k best, are scored in full. Only scores that reach the threshold leave a task, at most k for each query.

Terms are known by their 64-bit XXH3 hash.

Defined cases: a null or empty text is a document without terms and is found by no query; a query without terms, or with none that occurs, has no rows; query rows with one id are
one query; equal scores (to nine decimals) rank by id, nulls last; repeated rows are documents of their own; a query finds itself; texts of any length are read whole and stand in
one shard; an empty table gives no rows; other columns are not read, so their names never clash.
"""

from __future__ import annotations

import math
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from palaver.llm.common import settle, slices, stored
from palaver.llm.decontaminate import words

K1, B = 1.2, 0.75
BLOCK = 64
#: Bytes of text and documents in a shard at most, queries in a block of queries, and terms of all queries in one.
SHARD_BYTES, SHARD_DOCS, QUERIES, QUERY_TERMS = 32 << 20, 1 << 15, 16384, 2_000_000
#: Sixteenths of the shards that are searched up to the end of each round. A round holds at most some four times the shards before it, so about 4 k documents of it reach a query's threshold at any size.
ROUNDS = (1, 4, 16)
#: Common terms, of which a shard has a matrix, occur in this share of its documents; rows and cells of the matrix at most.
COMMON, MATRIX, MATRIX_CELLS = 0.01, 2048, 1 << 24
#: Cells of a product that take as long as opening a posting, queries that are asked at once, cells of their sums at most, cells that are summed at once, blocks in a product.
POSTING, BATCH, BATCH_CELLS, CELLS, TILE = 500, 256, 1 << 22, 1 << 17, 4
#: Documents in a group of like ones at least, its most common terms that are looked at, and the share of their variance that one direction has where the group is halved.
LEAST, LEADING, STANDING_OUT = 512, 192, 0.05
SLACK = 2e-9
INDEX = "round int, docs bigint, words bigint, ids array<bigint>, sizes binary, terms binary, counts binary, doc binary, tf binary"


def term_counts(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the distinct terms of a text and how often each occurs."""
    tf = Counter(words(text))
    return np.fromiter(map(xxhash.xxh3_64_intdigest, tf), np.uint64, len(tf)), np.fromiter(tf.values(), np.int32, len(tf))


def alike(doc: np.ndarray, place: np.ndarray, n: int, least: int = LEAST) -> list[np.ndarray]:
    """Documents 0 to ``n`` in groups of ``least`` at the fewest that share common words, such as those of a language.

    A group is halved, again and again, along the main direction of its documents' most common terms, where one stands out. Any grouping gives the same results.
    """
    if n < 2 * least:
        return [np.arange(n)]
    most = np.argsort(-np.bincount(place), kind="stable")[: 4 * LEADING]
    column = np.full(int(place.max(initial=0)) + 1, -1, np.int32)
    column[most] = np.arange(len(most))
    some = column[place] >= 0
    has = np.zeros((n, len(most)), bool)
    has[doc[some], column[place[some]]] = True

    def split(own: np.ndarray) -> list[np.ndarray]:
        if len(own) < 2 * least:
            return [own]
        x = has[own]
        x = x[:, np.argsort(-x.sum(axis=0), kind="stable")[:LEADING]].astype(np.float32)
        x /= np.maximum(1, np.sqrt(x.sum(axis=1, keepdims=True)))
        x -= x.mean(axis=0)
        spread, ways = np.linalg.eigh(x.T @ x)
        if spread[-1] < STANDING_OUT * max(float(spread.sum()), 1e-9):
            return [own]
        along = x @ ways[:, -1]
        cut = 0.0
        for _ in range(20):
            if not (low := along <= cut).any() or low.all():
                break
            cut = (along[low].mean() + along[~low].mean()) / 2
        low = along <= cut
        if min(low.sum(), (~low).sum()) < least:
            return [own]
        return split(own[low]) + split(own[~low])

    return split(np.arange(n))


def in_order(keys: np.ndarray) -> np.ndarray:
    """A stable argsort of whole numbers from zero by 16 bits at a time, for which numpy takes time in proportion."""
    order = np.argsort((keys & 0xFFFF).astype(np.uint16), kind="stable")
    for shift in range(16, int(keys.max(initial=0)).bit_length(), 16):
        order = order[np.argsort((keys[order] >> shift & 0xFFFF).astype(np.uint16), kind="stable")]
    return order


def packed(number: int, ids: list[int | None], vectors: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    """One row of the index: postings by term of documents, like ones together in the order of their length."""
    sizes = np.array([int(tf.sum()) for _, tf in vectors], np.int64)
    lengths = np.array([len(term) for term, _ in vectors])
    terms, place = np.unique(np.concatenate([term for term, _ in vectors]), return_inverse=True)
    order = np.concatenate([own[np.argsort(sizes[own], kind="stable")] for own in alike(np.repeat(np.arange(len(ids)), lengths), place, len(ids))])
    at = np.empty(len(ids), np.int32)
    at[order] = np.arange(len(ids))
    doc = np.repeat(at, lengths)
    by_doc = in_order(doc)
    by_term = by_doc[in_order(place[by_doc])]
    tf = np.concatenate([tf for _, tf in vectors])
    blobs = (sizes[order].astype(np.int32), terms, np.bincount(place, minlength=len(terms)).astype(np.int32), doc[by_term], tf[by_term])
    columns = [pa.array([number], pa.int32()), pa.array([len(ids)]), pa.array([int(sizes.sum())]), pa.array([[ids[i] for i in order]], pa.list_(pa.int64())), *[pa.array([x.tobytes()], pa.binary()) for x in blobs]]
    return pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in INDEX.split(", ")])


def build_index(docs: DataFrame, id_col: str, text_col: str, shard_bytes: int) -> DataFrame:
    """A row for each shard, written once, each round's apart; a task that reads texts makes its own shards, so nothing is shuffled."""

    def round_of(number: int) -> int:
        return bisect_right(ROUNDS, xxhash.xxh3_64_intdigest(number.to_bytes(8, "big")) % ROUNDS[-1])

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, vectors, size = [], [], 0
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            own = batch.column(0).to_pylist()
            for first, texts in slices(x.as_py() for x in batch.column(1)):
                for i, text in enumerate(texts, first):
                    ids.append(own[i])
                    vectors.append(term_counts(text))
                    size += len(text)
                    if size >= shard_bytes or len(ids) == SHARD_DOCS:
                        yield packed(round_of(number), ids, vectors)
                        ids, vectors, size, number = [], [], 0, number + 1
        if ids:
            yield packed(round_of(number), ids, vectors)

    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("binary").alias("_text"))
    return stored(rows.mapInArrow(build, INDEX), "index", by="round")


def document_frequencies(index: DataFrame) -> DataFrame:
    """(term, df) over all texts, from the shards' counts."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for terms, counts in zip(*batch.columns, strict=True):
                df = np.frombuffer(counts.as_buffer(), np.int32).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(terms.as_buffer(), np.int64)), pa.array(df)], ["term", "df"])

    return index.select("terms", "counts").mapInArrow(count, "term bigint, df bigint").groupBy("term").agg(F.sum("df").alias("df"))


def query_terms(queries: DataFrame, index: DataFrame, n_docs: int) -> DataFrame:
    """(query_id, term, idf): distinct terms of each query that occur, with their weights."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = batch.column(0).to_pylist()
            for first, texts in slices(x.as_py() for x in batch.column(1)):
                found = [term_counts(t)[0].view(np.int64) for t in texts]
                ids = np.repeat(np.array(own[first : first + len(texts)], np.int64), list(map(len, found)))
                yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(np.concatenate(found))], ["query_id", "term"])

    pairs = queries.mapInArrow(read, "query_id bigint, term bigint").distinct()
    idf = F.log1p((F.lit(n_docs) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    return settle(pairs.join(document_frequencies(index), "term").select("query_id", "term", idf.alias("idf")))


@dataclass
class Asked:
    """A block of queries: their distinct terms in order with weights, and each query's places among them."""

    ids: np.ndarray
    ends: np.ndarray
    places: np.ndarray
    terms: np.ndarray
    idf: np.ndarray
    thresholds: np.ndarray
    order: np.ndarray | None = None

    def batches(self, docs: int) -> Iterator[np.ndarray]:
        """Some queries each to ask a shard of so many documents, such as have words in common where these are known."""
        some = max(1, min(BATCH, BATCH_CELLS // max(1, docs)))
        order = np.arange(len(self.ids)) if self.order is None else self.order
        for first in range(0, len(order), some):
            yield order[first : first + some]

    @staticmethod
    def of(rows: pa.Table) -> Asked:
        query, term, idf = (rows.column(c).to_numpy() for c in ("query_id", "term", "idf"))
        order = np.argsort(query, kind="stable")
        ids, counts = np.unique(query, return_counts=True)
        terms, first, places = np.unique(term.view(np.uint64)[order], return_index=True, return_inverse=True)
        like = alike(np.repeat(np.arange(len(ids)), counts), places, len(ids)) if len(ids) else []
        return Asked(ids, np.concatenate([[0], np.cumsum(counts)]), places.astype(np.int32), terms, idf[order][first], np.zeros(len(ids)), np.concatenate([*like, np.zeros(0, np.int64)]).astype(np.int64))


class Shard:
    """The postings of some documents for the terms that a block of queries asks for, by term and by document, and the common terms as a matrix."""

    def __init__(self, row: dict[str, pa.Scalar], asked: Asked, mean: float):
        sizes, terms, counts, doc, tf = (np.frombuffer(row[c].as_buffer(), kind) for c, kind in (("sizes", np.int32), ("terms", np.uint64), ("counts", np.int32), ("doc", np.int32), ("tf", np.int32)))
        ids = row["ids"].values
        self.none = ids.is_null().to_numpy(zero_copy_only=False)
        self.ids = ids.fill_null(0).to_numpy()
        self.docs = (len(sizes) + BLOCK - 1) // BLOCK * BLOCK
        at = np.minimum(np.searchsorted(asked.terms, terms), len(asked.terms) - 1)
        hit = asked.terms[at] == terms
        keep = np.repeat(hit, counts)
        self.doc, tf, at, counts = doc[keep], tf[keep].astype(np.float64), at[hit], counts[hit].astype(np.int64)
        self.impact = tf * (K1 + 1) / (tf + (K1 * (1 - B + B * sizes / mean))[self.doc]) * np.repeat(asked.idf[at], counts)
        self.counts, self.ends = counts, np.cumsum(counts)
        self.starts = self.ends - counts
        self.most = np.maximum.reduceat(self.impact, self.starts) if len(at) else np.zeros(0)
        self.place = np.full(len(asked.terms), -1, np.int32)
        self.place[at] = np.arange(len(at))
        # The common terms also have a row of all documents each.
        rank = np.argsort(-counts, kind="stable")[: min(MATRIX, MATRIX_CELLS // max(1, self.docs))]
        self.common = rank[counts[rank] >= COMMON * len(sizes)]
        self.row = np.full(len(at), -1, np.int64)
        self.row[self.common] = np.arange(len(self.common))
        self.matrix = np.zeros((len(self.common), self.docs), np.float32)
        for r, t in enumerate(self.common.tolist()):
            self.matrix[r, self.doc[self.starts[t] : self.ends[t]]] = self.impact[self.starts[t] : self.ends[t]]
        self.block_most = self.matrix.reshape(len(self.common), self.docs // BLOCK, BLOCK).max(axis=2)
        # The same postings by document, for the scores in full.
        by_doc = in_order(self.doc)
        self.own_term, self.own_impact = np.repeat(np.arange(len(at), dtype=np.int32), counts)[by_doc], self.impact[by_doc]
        self.own_ends = np.cumsum(np.bincount(self.doc, minlength=self.docs))
        self.own_starts = np.concatenate([[0], self.own_ends[:-1]])
        self.asked_for = np.zeros(len(at), bool)

    def top(self, places: np.ndarray, threshold: float, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Documents and scores of the k best that reach the threshold, and those equal to the last of them."""
        for _, found, score in self.best(np.array([0, len(places)]), places, np.array([threshold]), k):
            return found, score
        return np.zeros(0, np.int64), np.zeros(0)

    def best(self, ends: np.ndarray, places: np.ndarray, thresholds: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """``top`` for some queries, whose terms end at ``ends``, at once: (query, documents, scores) of those that find any."""
        at = self.place[places]
        query = np.repeat(np.arange(len(thresholds)), np.diff(ends))[at >= 0]
        at = at[at >= 0]
        # Queries whose largest impacts stay below the threshold find nothing here.
        able = np.bincount(query, self.most[at], len(thresholds))
        able = np.flatnonzero((able > 0) & (able >= thresholds - SLACK))
        if not len(able):
            return
        new = np.full(len(thresholds), -1)
        new[able] = np.arange(len(able))
        at, query, thresholds = at[new[query] >= 0], new[query[new[query] >= 0]], thresholds[able]
        # Sums in 32 bits are off by less than one in 2**13, as a product has at most MATRIX terms.
        least = np.maximum((thresholds - SLACK) * (1 - 2.0**-13), 1e-30).astype(np.float32)
        row = self.row[at]
        asks = np.bincount(row[row >= 0], minlength=len(self.common)) * self.counts[self.common] * POSTING >= len(able) * self.docs
        idle = (row >= 0) & asks[row] if len(asks) else np.zeros(len(at), bool)
        score = self.opened(query[~idle], at[~idle], len(able))
        if idle.any():
            self.add_idle(score, query[idle], row[idle], asks, least)
        terms = np.searchsorted(query, np.arange(len(able) + 1))
        hit = score >= least[:, None]
        for q in np.flatnonzero(hit.any(axis=1)).tolist():
            found = np.flatnonzero(hit[q])
            if len(found) > k:
                near = score[q, found]
                found = found[near >= np.partition(near, -k)[-k] * np.float32(1 - 2.0**-12)]
            exact = self.in_full(at[terms[q] : terms[q + 1]], found)
            keep = exact >= thresholds[q] - SLACK
            if keep.sum() > k:
                keep &= exact >= np.partition(exact, -k)[-k] - SLACK
            if keep.any():
                yield int(able[q]), found[keep], exact[keep]

    def opened(self, query: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
        """Sums of the postings of these terms, by query and document; some queries at a time."""
        score = np.empty((n, self.docs), np.float32)
        some = max(1, CELLS // self.docs)
        for first in range(0, n, some):
            a, b = np.searchsorted(query, (first, first + some))
            counts = self.counts[at[a:b]]
            rows = min(some, n - first)
            place = np.repeat(self.starts[at[a:b]] - (np.cumsum(counts) - counts), counts)
            place += np.arange(len(place))
            cell = np.repeat((query[a:b] - first) * self.docs, counts)
            cell += self.doc[place]
            score[first : first + rows] = np.bincount(cell, self.impact[place], rows * self.docs).reshape(rows, self.docs)
        return score

    def add_idle(self, score: np.ndarray, query: np.ndarray, row: np.ndarray, asks: np.ndarray, least: np.ndarray) -> None:
        """Add the impacts of common terms in the blocks that can reach the threshold with their largest ones."""
        rows = np.flatnonzero(asks)
        column = np.cumsum(asks) - 1
        wanted = np.zeros((len(score), len(rows)), np.float32)
        wanted[query, column[row]] = 1
        whole = len(rows) == len(asks)
        matrix, most = (self.matrix, self.block_most) if whole else (self.matrix[rows], self.block_most[rows])
        bound = score.reshape(len(score), -1, BLOCK).max(axis=2) + wanted @ most
        live = np.logical_or.reduceat(bound >= least[:, None], np.arange(0, bound.shape[1], TILE), axis=1)
        for tile in np.flatnonzero(live.any(axis=0)).tolist():
            span = slice(tile * TILE * BLOCK, (tile + 1) * TILE * BLOCK)
            some = np.flatnonzero(live[:, tile])
            if len(some) > 0.8 * len(score):
                score[:, span] += wanted @ matrix[:, span]
            else:
                score[some, span] += wanted[some] @ matrix[:, span]

    def in_full(self, at: np.ndarray, found: np.ndarray) -> np.ndarray:
        """Scores of documents for the query with these terms."""
        self.asked_for[at] = True
        score = [self.own_impact[a:b][self.asked_for[self.own_term[a:b]]].sum() for a, b in zip(self.own_starts[found].tolist(), self.own_ends[found].tolist(), strict=True)]
        self.asked_for[at] = False
        return np.array(score)


Best = tuple[np.ndarray, np.ndarray, np.ndarray]  # scores, whether the id is null, ids


def merged(best: Best | None, more: Best, k: int) -> Best:
    """The k best of both by score, then id, nulls last."""
    scores, none, ids = (more if best is None else tuple(np.concatenate(x) for x in zip(best, more, strict=True)))
    order = np.lexsort((ids, none, -scores))[:k]
    return scores[order], none[order], ids[order]


def searcher(held, mean: float, k: int):
    """Function from shards to the best of all of them for each query of a broadcast block."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked: Asked = held.value
        best: dict[int, Best] = {}
        reached = asked.thresholds.copy()
        for batch in batches:
            for i in range(batch.num_rows):
                shard = Shard({name: batch.column(name)[i] for name in batch.schema.names}, asked, mean)
                for some in asked.batches(shard.docs):
                    ends = np.concatenate([[0], np.cumsum(asked.ends[some + 1] - asked.ends[some])])
                    places = np.concatenate([asked.places[asked.ends[q] : asked.ends[q + 1]] for q in some.tolist()])
                    for n, found, score in shard.best(ends, places, reached[some], k):
                        q = int(some[n])
                        best[q] = merged(best.get(q), (np.round(score, 9), shard.none[found], shard.ids[found]), k)
                        if len(best[q][0]) == k:
                            reached[q] = max(reached[q], best[q][0][-1])
                del shard  # one at a time is held
        for q, (scores, none, ids) in best.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ids), asked.ids[q])), pa.array(ids, mask=none), pa.array(scores)], ["query_id", "doc_id", "score"])

    return search


def top_k(docs: DataFrame, queries: DataFrame, k: int = 10, id_col: str = "doc_id", text_col: str = "text", query_id: str = "query_id", query_text: str = "text", shard_bytes: int = SHARD_BYTES, block: int = QUERIES) -> DataFrame:
    """(query_id, rank, doc_id, score): the k best documents for every query."""
    spark = docs.sparkSession
    index = build_index(docs, id_col, text_col, shard_bytes)
    n_docs, tokens = index.agg(F.coalesce(F.sum("docs"), F.lit(0)), F.coalesce(F.sum("words"), F.lit(0))).first()
    mean = max(1.0, tokens / max(1, n_docs))
    asked = queries.select(F.col(query_id).cast("bigint").alias("query_id"), F.col(query_text).cast("binary").alias("_query")).filter("query_id IS NOT NULL")
    terms = query_terms(asked, index, n_docs)
    n_queries, n_terms = terms.agg(F.count_distinct("query_id"), F.count("*")).first()
    parts = max(1, math.ceil(n_queries / block), math.ceil(n_terms / QUERY_TERMS))
    schema = "query_id bigint, doc_id bigint, score double"
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc_nulls_last("doc_id")))
    found = None
    for part in range(parts):
        block_of = Asked.of(terms.filter(F.pmod(F.xxhash64("query_id"), F.lit(parts)) == part).toArrow())
        if not len(block_of.ids):
            continue
        so_far = None
        for number in range(len(ROUNDS)):
            held = spark.sparkContext.broadcast(block_of)
            some = settle(index.filter(F.col("round") == number).mapInArrow(searcher(held, mean, k), schema))
            held.destroy()
            so_far = some if so_far is None else so_far.unionByName(some)
            if number < len(ROUNDS) - 1:
                reached = so_far.withColumn("rank", rank).filter(F.col("rank") == k).select("query_id", "score").toArrow()
                block_of.thresholds[np.searchsorted(block_of.ids, reached.column("query_id").to_numpy())] = reached.column("score").to_numpy()
        found = so_far if found is None else found.unionByName(so_far)
    if found is None:
        found = spark.createDataFrame([], schema)
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "doc_id", "score")


def like_texts(docs: DataFrame, every: int = 50, k: int = 10, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Top-k over all texts for each text whose id is divisible by ``every``, with the whole text as the query."""
    queries = docs.filter(F.col(id_col) % every == 0).select(F.col(id_col).alias("query_id"), F.col(text_col).alias("text"))
    return top_k(docs, queries, k, id_col, text_col)


#: The same top ten by joins: every query meets every document that has one of its terms.
SQL = r"""
WITH words AS (
  SELECT row_number() OVER () AS place, doc_id,
    list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ!"#$%&''()*+,-./:;<=>?@[\]^_`{|}~', 'abcdefghijklmnopqrstuvwxyz                                '), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words
  FROM documents),
numbers AS (SELECT count(*) AS n, greatest(1.0, sum(len(words)) / count(*)) AS mean FROM words),
postings AS (SELECT place, doc_id, any_value(size) AS size, term, count(*) AS tf FROM (SELECT place, doc_id, len(words) AS size, unnest(words) AS term FROM words) GROUP BY place, doc_id, term),
frequencies AS (SELECT term, ln(1 + (n - count(*) + 0.5) / (count(*) + 0.5)) AS idf FROM postings, numbers GROUP BY term, n),
asked AS (SELECT DISTINCT doc_id AS query_id, term FROM postings WHERE doc_id % 50 = 0),
scores AS (
  SELECT query_id, place, doc_id, round(sum(idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * size / mean))), 9) AS score
  FROM asked JOIN postings USING (term) JOIN frequencies USING (term), numbers GROUP BY query_id, place, doc_id),
ranked AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id NULLS LAST) AS INT) AS rank, doc_id, score FROM scores)
SELECT query_id, rank, doc_id, score FROM ranked WHERE rank <= 10
"""
