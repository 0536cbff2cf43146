"""Operator 9: SimHash near-duplicates with pigeonring candidate filtering.

A text's fingerprint has a bit set where more than half of its shingle hashes have it. Fingerprints
of 64 bits are cut into four segments on a ring. If two differ in at most three bits, then (pigeonring,
chains of length two) at some start segment they agree, and over it and the next segment together they differ in at most one
bit. So a pair can only meet under a key made of both segments, with the second as it is or with one bit flipped; longer
chains and at last the full distance are checked where they meet.

Equal fingerprints are one node, so copies never form pairs. Under each key a spanning forest of the
links is kept instead of all pairs: breadth first search compares a node with the not yet reached ones alone.
Keys with more than ``TILE`` nodes are dealt to pairs of tiles, so no key needs one task.

Defined cases: a text without words (null, empty, white space) has fingerprint zero and is linked like any
other; repeated rows and rows with a null id are members like others (a component of null ids alone has a null id, and is still kept as one row);
an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palaver.llm.common import fresh, settle, slices, stored

WORDS = 3
DISTANCE = 3
SEED = 42
SEGMENTS, WIDTH = 4, 16
#: Nodes under one key that one step compares; larger keys are dealt to pairs of tiles of about this size.
TILE = 4096
#: Links that a task of a step towards components writes.
LINKS = 1 << 14


def fingerprint(text: bytes, words: int = WORDS) -> int:
    """SimHash of a text; A to Z are lower-cased, words are split at ASCII white space."""
    tokens = text.lower().split()
    if not tokens:
        return 0
    joined = b" ".join(tokens)
    if len(tokens) <= words:
        return xxhash.xxh64_intdigest(joined, SEED)
    lengths = np.fromiter(map(len, tokens), np.int64, len(tokens))
    ends = np.cumsum(lengths + 1) - 1
    starts = (ends - lengths)[: len(tokens) - words + 1].tolist()
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(joined[a:b], SEED) for a, b in zip(starts, ends[words - 1 :].tolist(), strict=True)], np.uint64)
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        part = hashes[at : at + (1 << 16)]
        counts += np.unpackbits(part.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(hashes), bitorder="little").view("<u8")[0])


def fingerprint_column(text: Column, words: int = WORDS) -> Column:
    """Fingerprints as signed 64-bit integers."""

    @F.arrow_udf("bigint")
    def fingerprints(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            found = [fingerprint(t, words) for _, part in slices(x.as_py() for x in batch) for t in part]
            yield pa.array(np.array(found, np.uint64).view(np.int64), pa.int64())

    return fingerprints(text.cast("binary"))


def candidate_keys(nodes: DataFrame) -> DataFrame:
    """(key, fp): each node under its own key of every start segment, and as a visitor under lower keys one bit away.

    The key holds the start segment's number and the values of it and the next one. A pair whose second
    segments differ meets once, under the smaller of both values.
    """
    fp = F.col("fp")
    pieces = [F.shiftrightunsigned(fp, WIDTH * s).bitwiseAND(F.lit((1 << WIDTH) - 1)) for s in range(SEGMENTS)]
    homes = F.array(*[F.struct(F.lit(s).cast("bigint").alias("s"), pieces[s].alias("a"), pieces[(s + 1) % SEGMENTS].alias("b")) for s in range(SEGMENTS)])
    at_home = nodes.select("fp", F.explode(homes).alias("h"))
    flips = F.expr(f"filter(transform(sequence(0, {WIDTH - 1}), i -> h.b ^ shiftleft(1L, i)), v -> v < h.b)")
    seen = at_home.select("fp", "h", F.explode(F.concat(F.array(F.col("h.b")), flips)).alias("b"))
    key = F.shiftleft(F.col("h.s"), 2 * WIDTH).bitwiseOR(F.shiftleft(F.col("h.a"), WIDTH)).bitwiseOR(F.col("b"))
    return seen.select(key.alias("key"), "fp")


def near(one: np.uint64, others: np.ndarray, start: int, most: int = DISTANCE) -> np.ndarray:
    """Which of ``others`` link with ``one``: pigeonring chains from ``start``, then the full distance."""
    differ = others ^ one
    keep = np.arange(len(others))
    for length in range(2, SEGMENTS):
        mask = np.uint64(0)
        for k in range(length):
            mask |= np.uint64((1 << WIDTH) - 1) << np.uint64(WIDTH * ((start + k) % SEGMENTS))
        keep = keep[np.bitwise_count(differ[keep] & mask) <= most * length // SEGMENTS]
    return keep[np.bitwise_count(differ[keep]) <= most]


def forest(fps: np.ndarray, start: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links among the nodes under one key."""
    left = fps
    a, b = [], []
    while len(left) > 1:
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            one = queue.pop()
            hit = near(one, left, start)
            if len(hit):
                reached = left[hit]
                a.append(np.full(len(reached), one, np.uint64))
                b.append(reached)
                queue.extend(reached)
                left = np.delete(left, hit)
    none = np.zeros(0, np.uint64)
    return np.concatenate([none, *a]), np.concatenate([none, *b])


def key_links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Forests of all keys of a partition that is sorted by (key, tile); a key may go on in the next batch."""
    held_k, held_t, held_f = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)

    def links(k: np.ndarray, t: np.ndarray, f: np.ndarray) -> pa.RecordBatch:
        a, b = [np.zeros(0, np.uint64)], [np.zeros(0, np.uint64)]
        if len(k):
            new = np.flatnonzero((k[1:] != k[:-1]) | (t[1:] != t[:-1])) + 1
            begin, end = np.concatenate([[0], new]), np.concatenate([new, [len(k)]])
            size = end - begin
            two = begin[size == 2]  # by far the most common; all at once
            differ = f[two] ^ f[two + 1]
            hit = two[np.bitwise_count(differ) <= DISTANCE]
            a.append(f[hit])
            b.append(f[hit + 1])
            for i, j in zip(begin[size > 2].tolist(), end[size > 2].tolist(), strict=True):
                x, y = forest(np.unique(f[i:j]), int(k[i] >> (2 * WIDTH)))
                a.append(x)
                b.append(y)
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(a).view(np.int64)), pa.array(np.concatenate(b).view(np.int64))], ["a", "b"])

    for batch in batches:
        k = np.concatenate([held_k, batch.column(0).to_numpy()])
        t = np.concatenate([held_t, batch.column(1).to_numpy()])
        f = np.concatenate([held_f, batch.column(2).to_numpy().view(np.uint64)])
        if not len(k):
            continue
        whole = int(np.flatnonzero((k != k[-1]) | (t != t[-1]))[-1]) + 1 if (k[0] != k[-1] or t[0] != t[-1]) else 0
        held_k, held_t, held_f = k[whole:], t[whole:], f[whole:]
        yield links(k[:whole], t[:whole], f[:whole])
    yield links(held_k, held_t, held_f)


def fingerprint_links(nodes: DataFrame, tile: int = TILE) -> DataFrame:
    """Links (a, b) whose components are those of all pairs of nodes within the distance."""
    keys = candidate_keys(nodes)
    sizes = keys.groupBy("key").count().filter(F.col("count") > 1)
    # A key with n nodes is dealt to g = ceil(n / tile) tiles; a node goes to each pair of tiles with its own.
    dealt = (
        keys.join(sizes, "key")
        .withColumn("g", F.ceil(F.col("count") / tile).cast("int"))
        .withColumn("own", F.pmod(F.xxhash64("fp"), F.col("g")).cast("int"))
        .select("key", "fp", "g", "own", F.explode(F.when(F.col("g") == 1, F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.col("g") - 1))).alias("other"))
        .select("key", (F.least("own", "other") * F.col("g") + F.greatest("own", "other")).cast("bigint").alias("tile"), "fp")
    )
    spread = dealt.repartition(F.col("key"), F.col("tile")).sortWithinPartitions("key", "tile")
    return spread.mapInArrow(key_links, "a bigint, b bigint").distinct()


def components(links: DataFrame, rounds: int = 50) -> DataFrame:
    """(node, root) for every node in a link; the root is the smallest node of its component.

    Alternates large-star and small-star steps until no link changes; sums over the links tell whether one did. Links point to the smaller node. In a large-star step a link
    moves on to the least node that its lower end points to. In a small-star step the link to a node's least neighbour stays, and any other one becomes a link between both neighbours. So each
    link stays one link, none has to be told from its copies by a shuffle, and the minima are combined before they are shuffled. What a step makes is stored as files of which a task of the next one reads many.
    """
    sums = lambda df: tuple(df.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0))).first())
    now = stored(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v"), "links")
    print_of = sums(now)
    # As many tasks write a step's links as their number asks for.
    kept = lambda df: stored(df.coalesce(print_of[0] // LINKS + 1), "links")
    for _ in range(rounds):
        below = now.groupBy(F.col("u").alias("v")).agg(F.min("v").alias("m"))
        large = kept(now.join(below, "v", "left").select("u", F.coalesce("m", "v").alias("v")))
        lower = large.groupBy("u").agg(F.min("v").alias("m"))
        now = kept(large.join(lower, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v")))
        before, print_of = print_of, sums(now)
        if print_of == before:
            break
    else:
        raise RuntimeError("components did not settle")
    ends = now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")))
    return stored(ends.groupBy("node").agg(F.min("root").alias("root")).coalesce(2 * print_of[0] // LINKS + 1), "roots")


def with_representatives(docs: DataFrame, id_col: str, text_col: str, words: int) -> DataFrame:
    """(doc_id, mark, fp, best): every row with the row that stands for its component, the smallest by id.

    Rows without an id come after all others; rows with one id are told apart by ``mark``, a hash of their text.
    """
    mark = F.xxhash64(F.coalesce(F.col(text_col).cast("string"), F.lit("")))
    prints = settle(docs.select(F.col(id_col).alias("doc_id"), mark.alias("mark"), fingerprint_column(F.col(text_col), words).alias("fp")))
    own = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "mark")
    nodes = settle(prints.groupBy("fp").agg(F.min(own).alias("least")))
    roots = components(fingerprint_links(nodes.select("fp")))
    rooted = nodes.join(roots, nodes.fp == roots.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    best = rooted.groupBy("root").agg(F.min("least").alias("best"))
    return prints.join(rooted.join(best, "root").select("fp", "best"), "fp")


def simhash_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS) -> DataFrame:
    """doc_id, fingerprint (16 hexadecimal digits) and component_id (the smallest doc_id reachable) of every row."""
    found = with_representatives(docs, id_col, text_col, words)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("best.doc_id").alias("component_id"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS) -> DataFrame:
    """The row with the smallest id of every component, whole and with all columns; of rows with the same id and text one stays."""
    mark, kept_id, kept_mark = fresh(docs, "_mark"), fresh(docs, "_kept_id"), fresh(docs, "_kept_mark")
    found = with_representatives(docs, id_col, text_col, words)
    kept = found.filter(F.col("doc_id").eqNullSafe(F.col("best.doc_id")) & F.col("mark").eqNullSafe(F.col("best.mark"))).select(F.col("doc_id").alias(kept_id), F.col("mark").alias(kept_mark)).distinct()
    marked = docs.withColumn(mark, F.xxhash64(F.coalesce(F.col(text_col).cast("string"), F.lit(""))))
    same = F.col(id_col).eqNullSafe(F.col(kept_id)) & F.col(mark).eqNullSafe(F.col(kept_mark))
    return marked.join(kept, same, "left_semi").dropDuplicates([id_col, mark]).drop(mark)
