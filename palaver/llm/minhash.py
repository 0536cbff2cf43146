"""Operator 11: MinHash near-duplicates with sequential Bayesian verification.

A text's set of word shingles has ``BANDS`` keys, each made of ``DEPTH`` minimum hashes; texts meet under equal keys. Two sets of similarity ``LEAST`` meet under
none of them with a probability of (1 - LEAST**DEPTH)**BANDS, about one in eight million. Pairs that meet are compared by other minimum hashes, a batch of ``BATCH`` at a
time: after each batch the posterior probability (uniform prior) that the similarity is ``LEAST`` or more follows from the matches so far, and a pair for which it is
below ``MISS`` is left. What survives all batches is verified on the whole sets, in whole numbers, so no link is wrong.

No pair is formed for its own sake. Equal sets are one node. Under each key the nodes are compared with its most central node first, and each node's likeliest partner is verified. Then
only keys that still hold several components are looked at, and in them only nodes that are likely to be near one of another component. These bring along their sets by halves of the hashes, which never make two sets less alike than they are;
where they meet, the likeliest pair of any two components that passes becomes a row and is verified, and the others only if one of these fails. So copies of one text that are
too far apart, however many, make no rows. A group of near copies costs about as many verified pairs as it has nodes. Keys of many nodes or large sets are dealt to pairs of tiles, the partners of one node to several tasks.

Defined cases: a text without words (null, empty, white space) has an empty set and is linked with nothing; with fewer words than a shingle the whole sequence is the one shingle. Repeated rows and rows
with a null id are members like others (a component of null ids alone has a null id). Texts of any length are read whole, and ties of similarity are links (LEAST is reached).
Other columns, whatever their names, are ignored by ``near_groups`` and kept by ``keep_one``; an empty table gives no rows. Shingles and sets are told apart by hashes of 64 bits.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palaver.llm.common import bitmap, fresh, in_bitmap, join_split, no_broadcasts, row_key, runs, slices, small_batches, stored
from palaver.llm.simhash import components

WORDS, PERCENT, SEED = 2, 80, 42
BANDS, DEPTH = 40, 5
#: Hashes of a signature (a byte each), how many are compared at a time, and the probability at which a pair is left.
PROOF, BATCH, MISS = 256, 32, 1e-7
#: Nodes under one key, and shingles of all their sets, that one step compares, and partners of a node that one task verifies; more are dealt to several.
TILE, LOAD, FAN = 2048, 1 << 21, 256
#: Hashes of words that a task remembers, and the longest such word; shingles that meet all hash functions at once.
KNOWN, LONGEST, BLOCK = 1 << 17, 64, 2048
MIX = [np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)]


def settle(df: DataFrame) -> DataFrame:
    """Cut the lineage of a table of pairs or nodes. As files: a task of a later step reads many small ones, while a checkpoint gives each later step as many tasks as it has parts, however few its rows."""
    return stored(df, "step")


class Words(dict):
    """Hashes of words, remembered unless they are long."""

    def __missing__(self, word: bytes) -> int:
        found = xxhash.xxh64_intdigest(word, SEED)
        if len(word) <= LONGEST:
            self[word] = found
        return found


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(29))) * MIX[1]
    return x ^ (x >> np.uint64(32))


def shingle_set(text: bytes, known: Words, words: int = WORDS) -> np.ndarray:
    """Sorted hashes of the distinct shingles; A to Z are lower-cased, words are split at ASCII white space."""
    tokens = text.lower().split()
    if len(known) > KNOWN:
        known.clear()
    h = np.fromiter(map(known.__getitem__, tokens), np.uint64, len(tokens))
    size = min(words, len(h))
    if not size:
        return h
    # Shingles of any number of words are told apart by their length as well.
    found = np.full(len(h) - size + 1, MIX[2] * np.uint64(size), np.uint64)
    for k in range(size):
        found = mixed(found * MIX[0] + h[k : len(h) - size + 1 + k])
    return np.unique(found)


def hash_functions(n: int, seed: int = SEED) -> np.ndarray:
    """Odd factors; a shingle's hash is the product of its upper half with one, modulo 2**32."""
    return np.random.default_rng(seed).integers(0, 1 << 31, n, np.uint32) * np.uint32(2) + np.uint32(1)


def minima(found: np.ndarray, factors: np.ndarray) -> np.ndarray:
    """The least hash of a set by each function."""
    least = np.full(len(factors), np.iinfo(np.uint32).max, np.uint32)
    upper = (found >> np.uint64(32)).astype(np.uint32)
    for at in range(0, len(found), BLOCK):
        part = upper[at : at + BLOCK]
        for k in range(0, len(factors), 32):
            np.minimum(least[k : k + 32], np.multiply.outer(factors[k : k + 32], part).min(axis=1), out=least[k : k + 32])
    return least.astype(np.uint64)


def band_keys(least: np.ndarray, depth: int = DEPTH) -> np.ndarray:
    rows = least.reshape(-1, depth)
    key = np.arange(1, len(rows) + 1).astype(np.uint64)
    for k in range(depth):
        key = mixed(key * MIX[0] + rows[:, k])
    return key.view(np.int64)


def fewest_matches(percent: int = PERCENT, proof: int = PROOF, batch: int = BATCH, miss: float = MISS) -> list[tuple[int, int]]:
    """(hashes compared, least matches) for each batch: with fewer, the posterior of a similarity of ``percent`` or more is below ``miss``.

    Two bytes match with probability p = s + (1 - s) / 256 at similarity s. With a uniform prior of p, the posterior of p >= t after m matches of n is that of at
    most m successes in n + 1 trials of probability t.
    """
    t = percent / 100 + (1 - percent / 100) / 256
    out = []
    for n in range(batch, proof + 1, batch):
        total, m = (1 - t) ** (n + 1), 0
        while total < miss:
            m += 1
            total += math.comb(n + 1, m) * t**m * (1 - t) ** (n + 1 - m)
        out.append((n, m))
    return out


def survivors(x: np.ndarray, y: np.ndarray, looks: list[tuple[int, int]]) -> tuple[np.ndarray, np.ndarray]:
    """Rows of two arrays of signatures that no look rules out, and how many of their hashes match."""
    keep, matches, at = np.arange(len(x)), np.zeros(len(x), np.int64), 0
    for n, fewest in looks:
        matches = matches + (x[keep, at:n] == y[keep, at:n]).sum(axis=1)
        stay = matches >= fewest
        keep, matches, at = keep[stay], matches[stay], n
    return keep, matches


def fits(n: np.ndarray, m: np.ndarray, percent: int) -> np.ndarray:
    """Whether sets of these sizes can be similar enough."""
    return 100 * np.minimum(n, m) >= percent * np.maximum(n, m)


def signatures(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, PROOF)


def prints_of(docs: DataFrame, id_col: str, text_col: str, words: int) -> DataFrame:
    """(id, none, mark, node, n, keys, sig) of every row; node is null for an empty set."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        factors, known = hash_functions(BANDS * DEPTH + PROOF), Words()
        for batch in batches:
            for first, texts in slices(x.as_py() for x in batch.column(3)):
                nodes, sizes, keys, sigs = [], [], [], []
                for text in texts:
                    found = shingle_set(text, known, words)
                    least = minima(found, factors)
                    nodes.append(xxhash.xxh64_intdigest(found.tobytes(), SEED))
                    sizes.append(len(found))
                    keys.append(band_keys(least[: BANDS * DEPTH]) if len(found) else np.zeros(0, np.int64))
                    sigs.append((mixed(least[BANDS * DEPTH :]) >> np.uint64(56)).astype(np.uint8).tobytes())
                ends = np.cumsum([0, *map(len, keys)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [*batch.slice(first, len(texts)).columns[:3], pa.array(np.array(nodes, np.uint64).view(np.int64), mask=np.array(sizes) == 0), pa.array(sizes, pa.int64()), pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(keys))), pa.array(sigs, pa.binary())],
                    ["id", "none", "mark", "node", "n", "keys", "sig"],
                )

    none, mark = row_key(id_col, text_col)
    rows = docs.select(F.col(id_col).alias("id"), none.alias("none"), mark.alias("mark"), F.col(text_col).cast("binary").alias("text"))
    kind = docs.schema[id_col].dataType.simpleString()
    return stored(rows.mapInArrow(read, f"id {kind}, none boolean, mark bigint, node bigint, n bigint, keys array<bigint>, sig binary"), "prints")


def upper_halves(found: np.ndarray) -> np.ndarray:
    """Distinct upper halves of the hashes of a set, ascending; sets share at least as many of them as of the hashes themselves, but for halves that fell together within a set."""
    return np.unique((found >> np.uint64(32)).astype(np.uint32))


def sets_of(docs: DataFrame, id_col: str, text_col: str, owners: DataFrame, words: int, halves: bool = False) -> DataFrame:
    """(node, s): the whole sets of the nodes, each read from the row that owns it; with ``halves`` only the upper halves of the hashes."""
    held = docs.sparkSession.sparkContext.broadcast(bitmap(owners.select(F.xxhash64("none", "id", "mark").alias("key"))))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Words()
        for batch in batches:
            few = batch.column(0).filter(pa.array(in_bitmap(held.value, batch.column(1).to_numpy())))
            for _, texts in slices(x.as_py() for x in few):
                found = [shingle_set(t, known, words) for t in texts]
                nodes = np.array([xxhash.xxh64_intdigest(f.tobytes(), SEED) for f in found], np.uint64).view(np.int64)
                kept = [(upper_halves(f) if halves else f).tobytes() for f in found]
                yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(kept, pa.binary())], ["node", "s"])

    none, mark = row_key(id_col, text_col)
    rows = docs.select(F.col(text_col).cast("binary").alias("text"), F.xxhash64(none, F.col(id_col), mark).alias("key"))
    found = rows.mapInArrow(read, "node bigint, s binary")
    whole = stored(found.join(owners.select("node"), "node", "left_semi").dropDuplicates(["node"]), "sets")
    held.destroy()
    return whole


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets are similar enough. The partners of one node ``a`` are dealt to several tasks."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                union = np.sort(np.concatenate([x, y]), kind="stable")  # two sorted runs: merged in one go
                both = int((union[1:] == union[:-1]).sum())
                keep.append(100 * both >= percent * (len(union) - both))
            yield pa.RecordBatch.from_arrays(batch.columns[:2], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    fans = pairs.groupBy("a").agg(F.ceil(F.count("*") / FAN).cast("int").alias("g"))
    left = sets.join(fans, sets.node == fans.a).select("a", F.explode(F.sequence(F.lit(0), F.col("g") - 1)).alias("salt"), "g", F.col("s").alias("x"))
    salted = join_split(pairs, fans, "a").withColumn("salt", F.pmod(F.xxhash64("b"), F.col("g")).cast("int")).select("a", "b", "salt")
    right = salted.join(sets.select(F.col("node").alias("b"), F.col("s").alias("y")), "b")
    return settle(right.join(left, ["a", "salt"]).select("a", "b", "x", "y").mapInArrow(check, "a bigint, b bigint"))


def likely(pairs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """(a, b, m): the pairs that their sizes and signatures do not rule out."""
    looks = fewest_matches(percent)

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                some = np.flatnonzero(fits(batch.column(2).to_numpy(), batch.column(3).to_numpy(), percent))
                batch = batch.take(pa.array(some))
                keep, m = survivors(signatures(batch.column(4)), signatures(batch.column(5)), looks)
                yield pa.RecordBatch.from_arrays([*batch.take(pa.array(keep)).columns[:2], pa.array(m)], ["a", "b", "m"])

    left, right = (nodes.select(F.col("node").alias(k), F.col("n").alias(f"n{k}"), F.col("sig").alias(f"s{k}")) for k in "ab")
    return settle(join_split(pairs, left, "a").join(right, "b").select("a", "b", "na", "nb", "sa", "sb").mapInArrow(look, "a bigint, b bigint, m bigint"))


def tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, ...]]:
    """(key, tile, own, node, root, n, signatures, *rest) of all tiles that hold several components, from rows sorted by the hash of (key, tile)."""
    for group, key, tile, *rest in runs(batches):
        root = rest[2]
        new = np.flatnonzero((group[1:] != group[:-1]) | (key[1:] != key[:-1]) | (tile[1:] != tile[:-1])) + 1
        for i, j in zip([0, *new.tolist()], [*new.tolist(), len(key)], strict=True):
            if root[i:j].min() < root[i:j].max():
                own, node, roots, n, sig, *more = (c[i:j] for c in rest)
                yield key[i:j], tile[i:j], own, node, roots, n, np.frombuffer(b"".join(sig), np.uint8).reshape(-1, PROOF), *more


def partners(i: int, own: np.ndarray, root: np.ndarray, n: np.ndarray, sig: np.ndarray, percent: int, looks: list[tuple[int, int]]) -> tuple[np.ndarray, np.ndarray]:
    """Rows of a tile after row ``i`` that are in another component and likely near it, and the matches of their signatures."""
    rest = np.arange(i + 1, len(root))
    # In a tile of two parts only pairs across them count; those within one have a tile of their own.
    rest = rest[(root[rest] != root[i]) & fits(n[rest], n[i], percent) & ((own[rest] != own[i]) | (own[0] == own[-1]))]
    keep, m = survivors(np.broadcast_to(sig[i], (len(rest), PROOF)), sig[rest], looks)
    return rest[keep], m


def near_others(percent: int):
    """The rows of tiles whose node is likely near one of another component."""
    looks = fewest_matches(percent)

    def flagged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, tile, own, node, root, n, sig in tiles(batches):
            hit = np.zeros(len(node), bool)
            for i in range(len(node) - 1):
                found, _ = partners(i, own, root, n, sig, percent, looks)
                hit[found] = True
                hit[i] |= len(found) > 0
            yield pa.RecordBatch.from_arrays([pa.array(c[hit]) for c in (key, tile, own, node)], ["key", "tile", "own", "node"])

    return flagged


def across(percent: int, best: bool):
    """Pairs (a, b) of nodes in different components ``ra`` and ``rb`` that are near enough by the upper halves of their hashes; with ``best`` the likeliest of any two components."""
    looks = fewest_matches(percent)

    def tile_pairs(own: np.ndarray, node: np.ndarray, root: np.ndarray, n: np.ndarray, sig: np.ndarray, sets: np.ndarray) -> list[np.ndarray]:
        halves = [np.frombuffer(x, np.uint32) for x in sets]
        size = np.array([len(x) for x in halves])
        found = []
        for i in range(len(node) - 1):
            near, m = partners(i, own, root, n, sig, percent, looks)
            keep = np.zeros(len(near), bool)
            for at in range(0, len(near), 256):
                rows = near[at : at + 256]
                flat = np.concatenate([halves[r] for r in rows])
                place = np.minimum(np.searchsorted(halves[i], flat), size[i] - 1)
                both = np.add.reduceat(halves[i][place] == flat, np.cumsum(size[rows]) - size[rows], dtype=np.int64)
                both += np.minimum(n[rows] - size[rows], n[i] - size[i])  # halves that fell together
                keep[at : at + 256] = 100 * both >= percent * (n[rows] + n[i] - both)
            near, m = near[keep], m[keep]
            found.append(np.stack([np.full(len(near), node[i]), node[near], np.full(len(near), root[i]), root[near], m]))
        a, b, ra, rb, m = np.concatenate([np.zeros((5, 0), np.int64), *found], axis=1)
        turn = a > b
        a, b, ra, rb = np.where(turn, b, a), np.where(turn, a, b), np.where(turn, rb, ra), np.where(turn, ra, rb)
        if best and len(a):
            low, high = np.minimum(ra, rb), np.maximum(ra, rb)
            order = np.lexsort((b, a, -m, high, low))
            first = np.concatenate([[True], (low[order][1:] != low[order][:-1]) | (high[order][1:] != high[order][:-1])])
            a, b, ra, rb, m = (c[order][first] for c in (a, b, ra, rb, m))
        return [a, b, ra, rb, m]

    def paired(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, _, *tile in tiles(batches):
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in tile_pairs(*tile)], ["a", "b", "ra", "rb", "m"])

    return paired


def spread(dealt: DataFrame, nodes: DataFrame, roots: DataFrame, sets: DataFrame | None = None) -> DataFrame:
    """Rows (key, tile, own, node) with what tiles compare, each tile whole and sorted."""
    wide = dealt.join(nodes.select("node", "n", "sig"), "node").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    if sets is not None:
        wide = wide.join(sets, "node")
    # One column that sorts first holds each group together, as ``runs`` reads it.
    columns = [F.xxhash64("key", "tile").alias("group"), "key", "tile", "own", "node", "root", "n", "sig", *([] if sets is None else ["s"])]
    return wide.select(*columns).repartition("group").sortWithinPartitions("group", "key", "tile", "own", "node")


def near_rows(shared: DataFrame, roots: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """(key, tile, own, node) under keys of at least three nodes in several components: the nodes that are likely near one of another component. Two nodes under a key are a pair of their own."""
    rooted = stored(shared.join(roots, "node", "left").select("key", "node", "n", F.coalesce("root", "node").alias("root")), "rooted")
    mixed_keys = rooted.groupBy("key").agg(F.count("*").alias("c"), F.sum("n").alias("load"), F.min("root").alias("low"), F.max("root").alias("high")).filter("low < high AND c > 2")
    open_keys = mixed_keys.select("key", F.ceil(F.greatest(F.col("c") / TILE, F.col("load") / LOAD)).cast("int").alias("g"))
    dealt = (
        join_split(rooted, open_keys, "key")
        .withColumn("own", F.pmod(F.xxhash64("node"), F.col("g")))
        .select("key", "node", "own", "g", F.explode(F.when(F.col("g") == 1, F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.col("g") - 1))).alias("other"))
        .select("key", (F.least("own", "other") * F.col("g") + F.greatest("own", "other")).cast("bigint").alias("tile"), F.col("own").cast("bigint").alias("own"), "node")
    )
    return stored(spread(dealt, nodes, roots).mapInArrow(near_others(percent), "key bigint, tile bigint, own bigint, node bigint"), "near")


def links(docs: DataFrame, nodes: DataFrame, id_col: str, text_col: str, words: int, percent: int) -> DataFrame:
    """Links (a, b) between nodes, all verified, whose components are those of all links."""
    keys = nodes.select("node", "n", F.explode("keys").alias("key"))
    groups = stored(keys.groupBy("key").count().filter(F.col("count") > 1), "groups")
    met = stored(join_split(keys, groups, "key", counts=groups), "met")
    # A key is led by the node that meets most others under all its keys: in a group of copies of one text that is the text itself, or the copy that is changed least.
    central = met.groupBy("node").agg(F.sum(F.col("count") - 1).alias("degree"))
    leads = met.join(central, "node").groupBy("key").agg(F.max(F.struct("degree", "node")).alias("lead")).select("key", F.col("lead.node").alias("lead"))
    shared = join_split(met.select("key", "node"), stored(leads, "leads"), "key", counts=groups)
    owner = nodes.select("node", "best.*")
    owners = lambda some: settle(owner.join(some.select("node").distinct(), "node", "left_semi"))
    confirm = lambda pairs: verified(pairs, sets_of(docs, id_col, text_col, owners(pairs.select(F.explode(F.array("a", "b")).alias("node"))), words), percent)
    ordered = [F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")]
    pairs = shared.filter("node <> lead").select(F.col("lead").alias("a"), F.col("node").alias("b")).distinct()
    leads = likely(stored(pairs, "pairs"), nodes, percent)
    tried = settle(leads.groupBy("b").agg(F.max_by("a", F.struct("m", "a")).alias("a")).select("a", "b"))
    found, tried = confirm(tried), tried.select(*ordered)

    roots = components(found)
    near = near_rows(met.select("key", "node", "n"), roots, nodes, percent)
    halves = sets_of(docs, id_col, text_col, owners(near), words, halves=True)
    between = lambda roots, best: spread(near, nodes, roots, halves).mapInArrow(across(percent, best), "a bigint, b bigint, ra bigint, rb bigint, m bigint")
    one = between(roots, True).groupBy(F.least("ra", "rb").alias("u"), F.greatest("ra", "rb").alias("v")).agg(F.max(F.struct("m", "a", "b")).alias("x")).select("x.a", "x.b")
    root_of = lambda k: roots.select(F.col("node").alias(k), F.col("root").alias(f"r{k}"))
    apart = leads.join(root_of("a"), "a", "left").join(root_of("b"), "b", "left").filter(F.coalesce("ra", "a") != F.coalesce("rb", "b")).select(*ordered)
    one = settle(one.join(tried, ["a", "b"], "left_anti").distinct())
    more = settle(one.unionByName(apart.join(tried, ["a", "b"], "left_anti")).distinct())
    confirmed = confirm(more)
    found, tried = settle(found.unionByName(confirmed)), tried.unionByName(more)
    if one.join(confirmed, ["a", "b"], "left_anti").isEmpty():
        return found
    # Upper halves let a pair pass that is none: all that pass between components still apart are verified.
    rest = settle(between(components(found), False).select("a", "b").distinct().join(tried, ["a", "b"], "left_anti"))
    return settle(found.unionByName(confirm(rest)))


def grouped(docs: DataFrame, id_col: str, text_col: str, words: int, percent: int) -> DataFrame:
    """(id, none, mark, n, best): every row with the row that stands for its component, the smallest by id; null for an empty set."""
    with small_batches(docs.sparkSession), no_broadcasts(docs.sparkSession):
        prints = prints_of(docs, id_col, text_col, words)
        owner = F.min(F.struct("none", "id", "mark")).alias("best")
        nodes = stored(prints.filter("node IS NOT NULL").groupBy("node").agg(owner, *[F.first(c).alias(c) for c in ("n", "keys", "sig")]), "nodes")
        roots = components(links(docs, nodes, id_col, text_col, words, percent))
        rooted = nodes.select("node", "best").join(roots, "node", "left").select("node", F.coalesce("root", "node").alias("root"), "best")
        least = rooted.groupBy("root").agg(F.min("best").alias("least"))
        best = stored(rooted.join(least, "root").select("node", F.col("least").alias("best")), "best")
    return join_split(prints.select("id", "none", "mark", "node", "n"), best, "node", "left")


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id (the smallest doc_id reachable) and kept of every row."""
    found = grouped(docs, id_col, text_col, words, percent)
    group = F.when(F.col("best").isNull(), F.col("id")).otherwise(F.col("best.id"))
    return found.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), group.alias("component_id"), F.col("id").eqNullSafe(group).alias("kept"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """The row with the smallest id of every component, whole and with all columns, and all rows without words; of rows with the same id and text one stays."""
    found = grouped(docs, id_col, text_col, words, percent)
    stays = F.col("best").isNull() | ((F.col("none") == F.col("best.none")) & F.col("id").eqNullSafe(F.col("best.id")) & (F.col("mark") == F.col("best.mark")))
    keys = [fresh(docs, k) for k in ("_none", "_mark", "_id")]
    text_id = F.coalesce(F.col("id").cast("string"), F.lit(""))
    kept = found.filter(stays).select(F.col("none").alias(keys[0]), F.col("mark").alias(keys[1]), text_id.alias(keys[2]))
    none, mark = row_key(id_col, text_col)
    marked = docs.select("*", none.alias(keys[0]), mark.alias(keys[1]), F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias(keys[2]))
    return marked.join(kept, keys, "left_semi").dropDuplicates(keys).select(docs.columns)


#: The same without hashes of any kind: documents meet under shared shingles that are rare enough to be among the first ones of both sets (prefix filter), all such
#: pairs are counted out, and links are followed to the smallest id.
SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), sets AS MATERIALIZED (
  SELECT doc_id, list_distinct(CASE WHEN len(w) < 2 THEN w ELSE list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) END) AS s FROM words
), each AS MATERIALIZED (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM sets),
ordered AS MATERIALIZED (
  SELECT doc_id, n, g, row_number() OVER (PARTITION BY doc_id ORDER BY df, g) AS i FROM each JOIN (SELECT g, count(*) AS df FROM each GROUP BY 1) USING (g)
), first AS MATERIALIZED (SELECT doc_id, n, g FROM ordered WHERE i <= n - (80 * n + 99) // 100 + 1),
met AS MATERIALIZED (SELECT DISTINCT x.doc_id AS a, y.doc_id AS b FROM first x JOIN first y ON x.g = y.g AND x.doc_id < y.doc_id AND 100 * least(x.n, y.n) >= 80 * greatest(x.n, y.n)),
link AS MATERIALIZED (
  SELECT a, b FROM (SELECT a, b, len(list_intersect(x.s, y.s)) AS shared, len(x.s) + len(y.s) AS total FROM met JOIN sets x ON x.doc_id = a JOIN sets y ON y.doc_id = b) WHERE 100 * shared >= 80 * (total - shared)
), edge AS MATERIALIZED (SELECT a, b FROM link UNION SELECT b, a FROM link),
reach(a, b) AS (SELECT a, b FROM edge UNION SELECT r.a, e.b FROM reach r JOIN edge e ON e.a = r.b)
SELECT doc_id, len(s) AS n_shingles, least(doc_id, coalesce(m, doc_id)) AS component_id, doc_id <= coalesce(m, doc_id) AS kept
FROM sets LEFT JOIN (SELECT a, min(b) AS m FROM reach GROUP BY 1) ON a = doc_id
"""
