"""Operator 1: language-model scoring by online logistic context mixing over bits.

A text is read as units: a word's bytes and the white-space byte after it, or the byte 0xFF at the end of the text. Each bit of a unit is predicted by several hashed contexts:
its last bytes, all its bytes so far, and these with the gate, which looks back over the words before: the class of the frequent word that came last (words that share texts share a class),
and whether a sentence or line ended. Their stretched probabilities are combined by weights that the pattern of contexts found and the bit's number select; the weights learn online, by
gradient steps over training units predicted from the rest, and an adaptive map that is filled as they go refines each probability. Units end with a byte that no word has, so the probabilities of all texts sum to at most one.

Over word borders a second predictor works on passages. A text is cut into passages where its words say so (a hash of two units), and a context is the hash of the ``BEFORE`` units
ahead of a passage. If other training texts have the context, one bit tells whether the passage is the one that followed there most often; its probability is learnt from how often that
was right at each count. A passage that is, costs this bit alone; else its units are coded after it. A text is never predicted from itself: its own passage is taken off the counts.

Statistics cover all training texts and follow the corpus; nothing rare is left out. Counted units are sorted over the cluster and cut into pieces; a piece counts the contexts of all bytes so far by itself, and those
that reach into another piece (prefixes of its first or last unit) are summed over all and sent to all: at most some hundred for each piece. Contexts of the last bytes share a table of ``SLOTS`` counters by hash, as context mixers do. Each distinct
unit is scored once, however often it occurs; texts then sum their units by a join on the unit's hash, with the most frequent units (at most ``HEAVY``) looked up in place so that no key of the join is hot.

Units, tokens and contexts are known by 64-bit polynomial hashes.

Defined cases: a null text is the empty text (one token, the end); repeated rows are scored alike, each for itself; a null id hashes as the empty text; without training texts the base is log10(0.5 / 0.5) per token
and every bit has probability one half; texts and words of any length are scored whole; the byte 0xFF, which no UTF-8 text has, is read as 0xFE; other columns are not read, so their names never clash.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palaver.llm.common import crc_mod, slices, stored

END = 0xFF
#: Classes (none, or that of the frequent word that came last), twice as many gates, and the frequent words that are sorted into classes.
CLASSES, FREQUENT = 8, 64
GATES = 2 * CLASSES
#: Counters of the contexts of last bytes (a power of two), and units whose scores are broadcast.
SLOT_BITS, HEAVY = 22, 1 << 19
SLOTS = 1 << SLOT_BITS
#: Contexts that use the bytes of the unit so far look at most at so many.
DEPTH = 48
SHORT, DEEP = 3, 2
CONTEXTS = SHORT + DEEP
#: Of the training texts, one in so many teaches the weights, predicted from the others.
MIX_FOLDS = 10
RATE, BATCH, STRETCH_MOST, PRIOR = 0.5, 1024, 12.0, 0.4
BUCKETS = 25
#: Units in a piece, and rows of counts that a task holds.
CHUNK, HELD = 60_000, 4_000_000
#: Mean units in a passage, units in its context, and the largest count of followers that is told apart.
PASSAGE, BEFORE, FOLLOWERS = 24, 8, 16
MUL, STEP = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
BASE = 0x5851F42D4C957F2D
SALTS = np.arange(1, CONTEXTS + 1, dtype=np.uint64) * MUL


def mixed(h: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each value."""
    h = (h ^ (h >> np.uint64(32))) * STEP
    return (h ^ (h >> np.uint64(29))) * MUL


def squash(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -STRETCH_MOST, STRETCH_MOST)))


def stretched(ones: np.ndarray, zeros: np.ndarray) -> np.ndarray:
    return np.log((ones + PRIOR) / (zeros + PRIOR))


# Units of texts ---------------------------------------------------------------------------------


def powers(base: int, n: int) -> np.ndarray:
    return np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(n, base, np.uint64)]))


@dataclass
class Read:
    """Units of some texts: places in the joined bytes, number of the text, and hashes of unit and of lower-case word."""

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray  # of the byte that ends the unit
    text: np.ndarray
    first: np.ndarray  # of each text, its first unit
    unit: np.ndarray
    token: np.ndarray
    sums: np.ndarray  # of hashed bytes before each place

    def worded(self) -> np.ndarray:
        """Units that are tokens: those with a word."""
        return self.ends > self.starts


class Reader:
    """Reads slices of texts by array operations alone."""

    def __init__(self, classes: dict[int, int] | None = None):
        self.up = self.down = np.ones(0, np.uint64)
        ends = np.zeros(256, bool)
        ends[[32, 9, 10, 11, 12, 13, END]] = True
        self.is_end = ends
        self.value = mixed(np.arange(1, 257, dtype=np.uint64))
        found = sorted((classes or {}).items())
        self.words = np.array([h for h, _ in found], np.uint64)
        self.kinds = np.array([k for _, k in found], np.int64)

    def sums(self, data: np.ndarray) -> np.ndarray:
        if len(data) >= len(self.up):
            self.up, self.down = powers(BASE, len(data)), powers(pow(BASE, -1, 1 << 64), len(data))
        return np.concatenate([np.zeros(1, np.uint64), np.cumsum(self.value[data] * self.up[: len(data)])])

    def span(self, sums: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Hash of the bytes from each a up to b."""
        return mixed((sums[b] - sums[a]) * self.down[a] + (b - a).astype(np.uint64))

    def read(self, texts: list[bytes]) -> Read:
        joined = b"".join(x + b"\xff" for t in texts for x in (t.replace(b"\xff", b"\xfe"),))
        data = np.frombuffer(joined, np.uint8)
        ends = np.flatnonzero(self.is_end[data])
        starts = np.concatenate([[0], ends[:-1] + 1]) if len(ends) else ends
        closes = np.cumsum([len(t) + 1 for t in texts]) - 1
        first = np.searchsorted(ends, closes - np.array([len(t) for t in texts]))
        text = np.repeat(np.arange(len(texts)), np.diff(np.append(first, len(ends))))
        sums = self.sums(data)
        unit = self.span(sums, starts, ends + 1)
        token = self.span(self.sums(np.frombuffer(joined.lower(), np.uint8)), starts, ends)
        return Read(data, starts, ends, text, first, unit, token, sums)

    def gates(self, r: Read) -> np.ndarray:
        """Twice the class of the frequent word that came last in the text, plus one after the end of a sentence or line or at the beginning."""
        n = len(r.ends)
        kind = np.zeros(n, np.int64)
        if len(self.words):
            at = np.minimum(np.searchsorted(self.words, r.token), len(self.words) - 1)
            kind = np.where(self.words[at] == r.token, self.kinds[at], 0)
        place = np.arange(n)
        latest = np.maximum.accumulate(np.where(kind > 0, place, -1))
        latest = np.where(latest >= r.first[r.text], kind[latest], 0)
        letter = np.where(r.ends > r.starts, r.data[r.ends - 1], 0)
        stop = (r.data[r.ends] == 10) | (letter == 46) | (letter == 33) | (letter == 63)  # line break, full stop, ! and ?
        gate = np.concatenate([[1], (2 * latest + stop)[:-1]])
        gate[r.first] = 1
        return gate

    def passages(self, r: Read) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """First unit of each passage that is not the first of its text, hash of the units before it and of itself, and the passage of every unit."""
        before = np.concatenate([np.zeros(1, np.uint64), r.unit[:-1]])
        before[r.first] = 0
        cut = mixed(r.unit + np.uint64(3) * before) % np.uint64(PASSAGE) == 0
        begins = np.concatenate([[True], cut[:-1]])
        begins[r.first] = True
        number = np.cumsum(begins) - 1
        at = np.flatnonzero(begins)
        close = np.concatenate([r.ends[at[1:] - 1], r.ends[-1:]]) + 1
        home = r.first[r.text[at]]
        later = at > home
        back = np.maximum(at - BEFORE, home)
        ctx = self.span(r.sums, r.starts[back], r.starts[at])
        own = self.span(r.sums, r.starts[at], close)
        return at[later], ctx[later], own[later], number


def unit_key(unit: np.ndarray, gate: np.ndarray) -> np.ndarray:
    return mixed(unit + (gate.astype(np.uint64) + np.uint64(1)) * STEP)


def read_slices(batches: Iterator[pa.RecordBatch], reader: Reader, columns: int = 1) -> Iterator[tuple[Read, list[list]]]:
    """Units of slices of the texts in column 0, with the values of further columns."""
    for batch in batches:
        others = [batch.column(i).to_pylist() for i in range(1, columns)]
        for first, texts in slices(x.as_py() for x in batch.column(0)):
            yield reader.read(texts), [o[first : first + len(texts)] for o in others]


def summed(keys: list[np.ndarray], counts: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Distinct rows of the keys with their counts added up."""
    order = np.lexsort(keys[::-1]) if len(keys) > 1 else np.argsort(keys[0])
    keys = [k[order] for k in keys]
    new = np.flatnonzero(np.concatenate([[True], np.logical_or.reduce([k[1:] != k[:-1] for k in keys])])) if len(order) else np.zeros(0, np.int64)
    return [k[new] for k in keys], np.add.reduceat(counts[order], new, axis=0) if len(new) else counts[:0]


def corpus_counts(docs: DataFrame) -> DataFrame:
    """(a, b, n) over all training texts: tokens (a, with a null b) by how often they occur, and pairs of context and passage by how many texts have them."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader, tokens, pairs = Reader(), [], []
        for r, _ in read_slices(batches, reader):
            (token,), n = summed([r.token[r.worded()]], np.ones(int(r.worded().sum()), np.int64))
            tokens.append((token, n))
            at, ctx, own, _ = reader.passages(r)
            (_, ctx, own), _ = summed([r.text[at].astype(np.uint64), ctx, own], np.ones(len(at), np.int64))
            pairs.append((ctx, own))
            if sum(len(x) for x, _ in tokens) + sum(len(x) for x, _ in pairs) > HELD:
                yield from flat(tokens, pairs)
                tokens, pairs = [], []
        yield from flat(tokens, pairs)

    def flat(tokens: list, pairs: list) -> Iterator[pa.RecordBatch]:
        names = ["a", "b", "n"]
        if tokens:
            (token,), n = summed([np.concatenate([x for x, _ in tokens])], np.concatenate([x for _, x in tokens]))
            yield pa.RecordBatch.from_arrays([pa.array(token.view(np.int64)), pa.nulls(len(n), pa.int64()), pa.array(n)], names)
        if pairs:
            ctx, own = (np.concatenate(x) for x in zip(*pairs, strict=True))
            (ctx, own), n = summed([ctx, own], np.ones(len(ctx), np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(ctx.view(np.int64)), pa.array(own.view(np.int64)), pa.array(n)], names)

    rows = docs.filter("_fold >= 0").select("_text").mapInArrow(count, "a bigint, b bigint, n bigint")
    return rows.groupBy("a", "b").agg(F.sum("n").alias("n"))


def gate_classes(docs: DataFrame, frequent: list[int]) -> dict[int, int]:
    """Class (from 1) of each frequent word's hash: groups of words that tend to occur in the same training texts.

    Tasks count in how many texts two words meet; the driver joins the closest groups of the few words until ``CLASSES - 1`` are left.
    """
    if not frequent:
        return {}
    words = np.array(sorted(frequent), np.uint64)
    size = len(words)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met = np.zeros((size, size), np.int64)
        for r, _ in read_slices(batches, Reader()):
            at = np.minimum(np.searchsorted(words, r.token), size - 1)
            hit = words[at] == r.token
            there = np.zeros((len(r.first), size), np.float32)
            there[r.text[hit], at[hit]] = 1
            met += np.rint(there.T @ there).astype(np.int64)
        at = np.flatnonzero(met)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(met.ravel()[at])], ["i", "n"])

    met = np.zeros(size * size)
    for r in docs.filter("_fold >= 0").select("_text").mapInArrow(count, "i bigint, n bigint").groupBy("i").agg(F.sum("n").alias("n")).collect():
        met[r.i] = r.n
    met = met.reshape(size, size)
    alone = np.sqrt(np.maximum(np.diag(met), 1))
    like = met / alone / alone[:, None]
    groups = [[i] for i in range(size)]
    while len(groups) > CLASSES - 1:
        x, y = max(((x, y) for y in range(len(groups)) for x in range(y)), key=lambda p: like[np.ix_(groups[p[0]], groups[p[1]])].mean())
        groups[x] += groups.pop(y)
    return {int(words[i]): g + 1 for g, group in enumerate(groups) for i in group}


def unit_counts(docs: DataFrame, classes: dict[int, int]) -> DataFrame:
    """(unit, gate, a, b, n): counts in the texts that teach contexts, in those that teach weights, and in all texts."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader, held, rows = Reader(classes), [], 0
        for r, (folds,) in read_slices(batches, reader, 2):
            gate = reader.gates(r)
            fold = np.array(folds, np.int64)[r.text]
            key = unit_key(r.unit, gate)
            order = np.argsort(key)
            sorted_key = key[order]
            new = np.flatnonzero(np.concatenate([[True], sorted_key[1:] != sorted_key[:-1]]))
            every, fold = np.diff(np.append(new, len(order))), fold[order]
            counts = np.stack([np.add.reduceat((fold == k).astype(np.int64), new) for k in (0, 1)] + [every], axis=1)
            some = order[new]
            held.append((sorted_key[new], gate[some].astype(np.int8), counts.astype(np.int32), r.data, r.starts[some].astype(np.int32), r.ends[some].astype(np.int32) + 1))
            rows += len(some)
            if rows > HELD:
                yield flat(held)
                held, rows = [], 0
        if held:
            yield flat(held)

    def flat(held: list) -> pa.RecordBatch:
        key, gate, counts = (np.concatenate([h[i] for h in held]) for i in range(3))
        base = np.cumsum([0] + [len(h[3]) for h in held])[:-1]
        data = np.concatenate([h[3] for h in held])
        start, stop = (np.concatenate([h[i] + b for h, b in zip(held, base, strict=True)]) for i in (4, 5))
        order = np.argsort(key)
        key = key[order]
        new = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        counts, some = np.add.reduceat(counts[order].astype(np.int64), new, axis=0), order[new]
        length = stop[some] - start[some]
        ends = np.cumsum(length)
        picked = data[np.repeat(start[some] - (ends - length), length) + np.arange(int(ends[-1]))]
        units = pa.BinaryArray.from_buffers(pa.binary(), len(some), [None, pa.py_buffer(np.concatenate([[0], ends]).astype(np.int32)), pa.py_buffer(picked)])
        return pa.RecordBatch.from_arrays([units, pa.array(gate[some].astype(np.int32)), *[pa.array(np.ascontiguousarray(c)) for c in counts.T]], ["unit", "gate", "a", "b", "n"])

    rows = docs.select("_text", "_fold").mapInArrow(count, "unit binary, gate int, a bigint, b bigint, n bigint")
    return rows.groupBy("unit", "gate").agg(*[F.sum(c).alias(c) for c in ("a", "b", "n")])


PIECE = "units binary, lengths binary, gates binary, a binary, b binary, n binary"


def pieces_of(vocabulary: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """Units in order, about ``chunk`` to a row, so that later passes need no sort and know where a piece begins and ends."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0
        for batch in batches:
            for part in (batch.slice(at, chunk) for at in range(0, batch.num_rows, chunk)):
                held.append(part)
                rows += part.num_rows
                if rows >= chunk:
                    yield packed(held)
                    held, rows = [], 0
        if rows:
            yield packed(held)

    def packed(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(held)
        units = table.column("unit").to_pylist()
        order = np.argsort(table.column("gate").to_numpy(), kind="stable")  # by gate, then unit
        columns = [np.fromiter(map(len, units), np.int32, len(units))[order], *[table.column(c).to_numpy()[order].astype(k) for c, k in (("gate", np.int32), ("a", np.int64), ("b", np.int64), ("n", np.int64))]]
        return pa.RecordBatch.from_arrays([pa.array([x], pa.binary()) for x in (b"".join(units[i] for i in order.tolist()), *[c.tobytes() for c in columns])], [c.split()[0] for c in PIECE.split(", ")])

    return vocabulary.repartitionByRange("unit").sortWithinPartitions("unit").mapInArrow(pack, PIECE)


class Piece:
    """Units of a piece by gate and in order, and the edges of their trie: the distinct (gate, prefix, next byte), with the hash of every context.

    An edge is shared by the rows with the same prefix; ``paths`` has pairs of row and edge. ``border`` marks prefixes that other pieces may have too.
    """

    def __init__(self, row: dict[str, pa.Scalar]):
        get = lambda c, kind: np.frombuffer(row[c].as_buffer(), kind)
        self.data, lengths, self.gates = get("units", np.uint8), get("lengths", np.int32).astype(np.int64), get("gates", np.int32)
        self.weights = {c: get(c, np.int64).astype(np.float64) for c in ("a", "b", "n")}
        n = len(lengths)
        self.lengths, self.starts = lengths, np.cumsum(lengths) - lengths
        starts, gates, data = self.starts, self.gates, np.append(self.data, np.zeros(1, np.uint8))
        blob = self.data.tobytes()
        units = [blob[s : s + k] for s, k in zip(starts.tolist(), lengths.tolist(), strict=True)]
        low, high = min(units), max(units)
        same = np.concatenate([[False], gates[1:] == gates[:-1]])
        common = self.shared(np.flatnonzero(same), lambda rows, p: (lengths[rows] > p) & (lengths[rows - 1] > p), lambda rows, p: data[starts[rows] + p] == data[starts[rows - 1] + p], n)
        reach = np.zeros(n, np.int64)
        for other in (low, high):
            found = self.shared(np.arange(n), lambda rows, p: (lengths[rows] > p) & (p < len(other)), lambda rows, p: data[starts[rows] + p] == other[min(p, len(other) - 1)], n)
            reach = np.maximum(reach, found)
        rows, places, prefixes, path_rows, path_edges, count = [], [], [], [], [], 0
        prefix, valid = np.zeros(n, np.uint64), np.arange(n)
        for p in range(DEPTH):
            valid = valid[lengths[valid] > p]
            if not len(valid):
                break
            first = common[valid] <= p
            path_rows.append(valid)
            path_edges.append(count + np.cumsum(first) - 1)
            here = valid[first]
            count += len(here)
            rows.append(here)
            places.append(np.full(len(here), p))
            prefixes.append(prefix[here])
            prefix[valid] = mixed(prefix[valid] + data[starts[valid] + p].astype(np.uint64) + np.uint64(1))
        long = np.flatnonzero(lengths > DEPTH)
        if len(long):
            more = lengths[long] - DEPTH
            rows.append(np.repeat(long, more))
            places.append(np.arange(int(more.sum())) - np.repeat(np.cumsum(more) - more, more) + DEPTH)
            prefixes.append(np.zeros(int(more.sum()), np.uint64))
            path_rows.append(rows[-1])
            path_edges.append(count + np.arange(int(more.sum())))
        self.row, self.place, whole = np.concatenate(rows), np.concatenate(places), np.concatenate(prefixes)
        self.paths = np.concatenate(path_rows), np.concatenate(path_edges)
        self.deep = self.place < DEPTH
        self.border = self.deep & (reach[self.row] >= self.place)
        at = starts[self.row] + self.place
        self.byte = data[at].astype(np.int64)
        gate = gates[self.row].astype(np.uint64) + np.uint64(1)
        before = [np.where(self.place > k, data[at - 1 - k], 0).astype(np.uint64) + np.where(self.place > k, 1, 0).astype(np.uint64) for k in range(4)]
        two = before[0] | before[1] << np.uint64(9)
        base = [before[0] | gate << np.uint64(9), two | before[2] << np.uint64(18) | before[3] << np.uint64(27), two | before[2] << np.uint64(18), whole, whole + gate * STEP]
        self.contexts = [mixed(h + salt) for h, salt in zip(base, SALTS, strict=True)]

    @staticmethod
    def shared(rows: np.ndarray, there, equal, n: int) -> np.ndarray:
        """How many bytes (up to ``DEPTH``) each row's unit shares with another."""
        found = np.zeros(n, np.int64)
        for p in range(DEPTH):
            rows = rows[there(rows, p)]
            rows = rows[equal(rows, p)]
            if not len(rows):
                break
            found[rows] = p + 1
        return found

    def sums(self, weights: np.ndarray) -> np.ndarray:
        """For each edge the sum of a weight over the rows below it."""
        rows, edges = self.paths
        return np.bincount(edges, weights[rows], len(self.row))

    def keys(self) -> np.ndarray:
        reader = Reader()
        return unit_key(reader.span(reader.sums(self.data), self.starts, self.starts + self.lengths), self.gates)

    def tokens(self) -> tuple[np.ndarray, np.ndarray]:
        """Hash of each unit's lower-case word, and whether it has one."""
        reader = Reader()
        return reader.span(reader.sums(np.frombuffer(self.data.tobytes().lower(), np.uint8)), self.starts, self.starts + self.lengths - 1), self.lengths > 1


def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[Piece]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield Piece({c: batch.column(c)[i] for c in batch.schema.names})


def slot_of(context: np.ndarray, partial: np.ndarray) -> np.ndarray:
    return (mixed(context + partial.astype(np.uint64) * STEP) >> np.uint64(64 - SLOT_BITS)).astype(np.int64)


def shared_counts(cut: DataFrame) -> DataFrame:
    """(slot, kind, byte, a, b, ones_a, ones_b): counters of the contexts of last bytes (kind -1, by slot), and the edges that lie at borders of pieces (kind: the context's number, by its hash)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, seen = [np.zeros(SLOTS) for _ in range(4)], False
        for piece in pieces(batches):
            a, b = piece.sums(piece.weights["a"]), piece.sums(piece.weights["b"])
            some = np.flatnonzero(a + b > 0)
            for context in piece.contexts[:SHORT]:
                (ctx, byte), n = summed([context[some], piece.byte[some]], np.stack([a[some], b[some]], axis=1))
                for j in range(8):
                    slot, one = slot_of(ctx, (1 << j) | (byte >> (8 - j))), (byte >> (7 - j)) & 1
                    for sums, w in zip(total, (n[:, 0], n[:, 1], n[:, 0] * one, n[:, 1] * one), strict=True):
                        np.add.at(sums, slot, w)
                seen = seen or len(ctx) > 0
            some = np.flatnonzero(piece.border & (a + b > 0))
            for k, context in enumerate(piece.contexts[SHORT:]):
                (ctx, byte), n = summed([context[some], piece.byte[some]], np.stack([a[some], b[some]], axis=1))
                yield rows(ctx.view(np.int64), np.full(len(ctx), k), byte, n[:, 0], n[:, 1], np.zeros(len(ctx)), np.zeros(len(ctx)))
        if seen:
            at = np.flatnonzero(total[0] + total[1])
            yield rows(at, np.full(len(at), -1), np.zeros(len(at), np.int64), *[x[at] for x in total])

    def rows(*columns: np.ndarray) -> pa.RecordBatch:
        kinds = (np.int64, np.int32, np.int32, np.int64, np.int64, np.int64, np.int64)
        return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c).astype(k)) for c, k in zip(columns, kinds, strict=True)], ["slot", "kind", "byte", "a", "b", "ones_a", "ones_b"])

    counted = cut.mapInArrow(count, "slot bigint, kind int, byte int, a bigint, b bigint, ones_a bigint, ones_b bigint")
    return counted.groupBy("slot", "kind", "byte").agg(*[F.sum(c).alias(c) for c in ("a", "b", "ones_a", "ones_b")])


# The model ------------------------------------------------------------------------------------------


@dataclass
class Shared:
    """What all pieces need: stretched counters of last bytes (nan: never seen), and counted edges at borders by context."""

    slots: np.ndarray
    border: list[tuple[np.ndarray, np.ndarray, np.ndarray]]  # for each deep context: sorted context, byte, count


class Mixer:
    """Bit predictions of edges from contexts, gated weights and an adaptive map."""

    def __init__(self, shared: Shared, weights: np.ndarray | None = None, refine: np.ndarray | None = None):
        self.shared = shared
        self.weights = np.full((8 << CONTEXTS, CONTEXTS), 0.35) if weights is None else weights
        self.refine = np.zeros((256 * BUCKETS, 2)) if refine is None else refine  # by partial byte and bucket: seen ones and all

    def inputs(self, piece: Piece, counts: np.ndarray, some: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each bit: stretched predictions of the contexts of the edges ``some``, and the set of weights that the pattern of contexts found selects."""
        stretch = np.zeros((8, CONTEXTS, len(some)), np.float32)
        found = np.zeros((8, len(some)), np.int64)
        byte = piece.byte[some]
        for j in range(8):
            partial = (1 << j) | (byte >> (8 - j))
            found[j] = j << CONTEXTS
            for k in range(SHORT):
                x = self.shared.slots[slot_of(piece.contexts[k][some], partial)]
                hit = ~np.isnan(x)
                stretch[j, k] = np.where(hit, x, 0)
                found[j] += hit.astype(np.int64) << k
        place = np.full(len(piece.row), -1, np.int64)
        place[some] = np.arange(len(some))
        use = np.flatnonzero(piece.deep)
        for k in range(DEEP):
            context = piece.contexts[SHORT + k]
            ctx, edge_byte, w = context[use], piece.byte[use], np.where(piece.border[use], 0.0, counts[use])
            known, known_byte, known_n = self.shared.border[k]
            mine = np.isin(known, context[piece.border])
            ctx, edge_byte, w = np.concatenate([ctx, known[mine]]), np.concatenate([edge_byte, known_byte[mine]]), np.concatenate([w, known_n[mine]])
            back = np.concatenate([place[use], np.full(int(mine.sum()), -1)])
            order = np.lexsort((edge_byte, ctx))
            ctx, edge_byte, w, back = ctx[order], edge_byte[order], w[order], back[order]
            asked = back >= 0
            other = np.concatenate([[True], ctx[1:] != ctx[:-1]]) if len(ctx) else np.zeros(0, bool)
            for j in range(8):
                high = edge_byte >> (8 - j)
                new = other.copy()
                new[1:] |= high[1:] != high[:-1]
                begin = np.flatnonzero(new)
                if not len(begin):
                    continue
                one = np.add.reduceat(w * ((edge_byte >> (7 - j)) & 1), begin)
                every = np.add.reduceat(w, begin)
                group = (np.cumsum(new) - 1)[asked]
                hit = every > 0
                stretch[j, SHORT + k, back[asked]] = np.where(hit, stretched(one, every - one), 0)[group]
                found[j, back[asked]] += hit[group].astype(np.int64) << (SHORT + k)
        return stretch, found

    def mix(self, stretch: np.ndarray, found: np.ndarray) -> np.ndarray:
        return np.einsum("kn,nk->n", stretch, self.weights[found])

    def cell(self, x: np.ndarray, partial: np.ndarray) -> np.ndarray:
        return partial * BUCKETS + np.clip(np.rint(x + BUCKETS // 2), 0, BUCKETS - 1).astype(np.int64)

    def learn(self, piece: Piece, counts: np.ndarray, weights: np.ndarray, steps: int) -> int:
        """Online: batches of edges are predicted, fill the adaptive map and move the weights of their sets; the weight of an edge is how often it occurs. Returns the steps so far."""
        some = np.random.default_rng(steps).permutation(np.flatnonzero(weights > 0))
        stretch, found = self.inputs(piece, counts, some)
        byte = piece.byte[some]
        for at in range(0, len(some), BATCH):
            part = slice(at, at + BATCH)
            w = weights[some[part]]
            damped = np.sqrt(w)  # damps the few very frequent edges of a batch
            rate = RATE / (1 + steps / 50)
            for j in range(8):
                bit, partial = (byte[part] >> (7 - j)) & 1, (1 << j) | (byte[part] >> (8 - j))
                x = self.mix(stretch[j, :, part], found[j, part])
                cell = self.cell(x, partial)
                np.add.at(self.refine[:, 0], cell, w * bit)
                np.add.at(self.refine[:, 1], cell, w)
                error = (bit - squash(x)) * damped
                low, high = j << CONTEXTS, (j + 1) << CONTEXTS
                sets = found[j, part] - low
                seen = np.bincount(sets, damped, high - low)
                for k in range(CONTEXTS):
                    self.weights[low:high, k] += rate * np.bincount(sets, error * stretch[j, k, part], high - low) / (seen + np.sqrt(seen + 1))
            steps += 1
        return steps

    def log2(self, piece: Piece, counts: np.ndarray) -> np.ndarray:
        """log2 probability of the byte of every edge."""
        some = np.arange(len(piece.row))
        stretch, found = self.inputs(piece, counts, some)
        total = np.zeros(len(some))
        for j in range(8):
            bit, partial = (piece.byte >> (7 - j)) & 1, (1 << j) | (piece.byte >> (8 - j))
            x = self.mix(stretch[j], found[j])
            p = squash(x)
            cells = self.refine[self.cell(x, partial)]
            p = (p + (cells[:, 0] + 8 * p) / (cells[:, 1] + 8)) / 2
            total += np.log2(np.where(bit == 1, p, 1 - p))
        return total


def shared_of(counts: DataFrame, columns: str) -> Shared:
    """The counters and border edges of some columns (``a``, or ``a + b``)."""
    n, ones = (" + ".join(f"{prefix}{c}" for c in columns.split(" + ")) for prefix in ("", "ones_"))
    slots = np.full(SLOTS, np.nan, np.float32)
    rows = counts.filter(f"kind = -1 AND {n} > 0").select(F.col("slot").cast("int").alias("slot"), F.expr(f"ln(({ones} + {PRIOR}) / ({n} - ({ones}) + {PRIOR}))").cast("float").alias("x")).toArrow()
    slots[rows.column("slot").to_numpy()] = rows.column("x").to_numpy()
    edges = counts.filter(f"kind >= 0 AND {n} > 0").selectExpr("kind", "slot", "byte", f"{n} AS n").toArrow()
    kind, ctx, byte, count = (edges.column(c).to_numpy() for c in ("kind", "slot", "byte", "n"))
    border = []
    for k in range(DEEP):
        mine = np.flatnonzero(kind == k)
        border.append((ctx[mine].view(np.uint64), byte[mine].astype(np.int64), count[mine].astype(np.float64)))
    return Shared(slots, border)


def train(cut: DataFrame):
    """Broadcast model (shared counts, weights, adaptive map) from the pieces of counted units."""
    spark = cut.sparkSession
    counts = stored(shared_counts(cut), "counts")
    first = spark.sparkContext.broadcast(shared_of(counts, "a"))
    size = (8 << CONTEXTS) * CONTEXTS

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mixer, steps, seen = Mixer(first.value), 0, 0.0
        for piece in pieces(batches):
            taught = piece.sums(piece.weights["b"])
            if taught.any():
                steps = mixer.learn(piece, piece.sums(piece.weights["a"]), taught, steps)
                seen += float(taught.sum())
        if seen:
            at = np.flatnonzero(mixer.refine[:, 1])
            i = np.concatenate([np.arange(size), size + at])
            x = np.concatenate([mixer.weights.ravel() * seen, mixer.refine[at, 0]])
            w = np.concatenate([np.full(size, seen), mixer.refine[at, 1]])
            yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(x), pa.array(w)], ["i", "x", "w"])

    learnt = cut.mapInArrow(learn, "i bigint, x double, w double").groupBy("i").agg(F.sum("x").alias("x"), F.sum("w").alias("w")).toArrow()
    i, x, w = (learnt.column(c).to_numpy() for c in ("i", "x", "w"))
    weights = refine = None
    if len(i):
        weights, refine = np.zeros(size), np.zeros((256 * BUCKETS, 2))
        weights[i[i < size]] = (x / w)[i < size]
        refine[i[i >= size] - size] = np.stack([x, w], axis=1)[i >= size]
        weights = weights.reshape(-1, CONTEXTS)
    first.destroy()
    return spark.sparkContext.broadcast((shared_of(counts, "a + b"), weights, refine))


def score_units(cut: DataFrame, model) -> DataFrame:
    """(key, token, worded, n, lp): log10 probability of each distinct unit after its gate."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mixer = Mixer(*model.value)
        for piece in pieces(batches):
            rows, at = piece.paths
            counts = piece.sums(piece.weights["a"] + piece.weights["b"])
            lp = np.bincount(rows, mixer.log2(piece, counts)[at], len(piece.lengths)) * np.log10(2)
            token, worded = piece.tokens()
            columns = (piece.keys().view(np.int64), token.view(np.int64), worded, piece.weights["n"].astype(np.int64), lp.astype(np.float32))
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["key", "token", "worded", "n", "lp"])

    return cut.mapInArrow(score, "key bigint, token bigint, worded boolean, n bigint, lp float")


class Lookup:
    """Places of hashes among known ones: evenly spread values are found by their high bits, then by stepping through a few."""

    def __init__(self, keys: np.ndarray, bits: int = 20):
        self.keys, self.shift = np.append(keys, np.zeros(1, np.uint64)), np.uint64(64 - bits)
        self.begin = np.searchsorted(keys, np.arange(1 << bits, dtype=np.uint64) << self.shift).astype(np.int32)
        self.end = np.append(self.begin[1:], np.int32(len(keys)))

    def find(self, asked: np.ndarray) -> np.ndarray:
        """The place of each, or -1."""
        found = np.full(len(asked), -1, np.int64)
        high = (asked >> self.shift).astype(np.int64)
        at, end, left = self.begin[high], self.end[high], np.arange(len(asked))
        while len(left):
            more = at < end
            at, end, left = at[more], end[more], left[more]
            hit = self.keys[at] == asked[left]
            found[left[hit]] = at[hit]
            at, end, left = at[~hit] + 1, end[~hit], left[~hit]
        return found


def most_frequent(counted: DataFrame, most: int) -> int:
    """The least power of two such that at most ``most`` rows have a count ``n`` of it or more."""
    sizes = {r.level: r["count"] for r in counted.groupBy(F.floor(F.log2("n")).alias("level")).count().collect()}  # one for each power of two
    held = 0
    for level in range(max(sizes, default=0), -1, -1):
        held += sizes.get(level, 0)
        if held > most:
            return 2 ** (level + 1)
    return 1


def followers(pairs: DataFrame) -> DataFrame:
    """(key, total, g1, n1, g2, n2) of each context: texts that have it, and the passages that follow it in most of them. The second is the best outside the first one's quarter of all hashes.

    Every step combines in its tasks before the shuffle, so no context is hot; equal counts go by hash.
    """
    rank = F.col("n") + F.pmod(F.xxhash64("b"), F.lit(1 << 20)) / float(1 << 21)
    quarters = pairs.groupBy("a", F.pmod("b", F.lit(4)).alias("e")).agg(F.sum("n").alias("t"), F.max("n").alias("n"), F.max_by("b", rank).alias("b"))
    each = [F.max(F.when(F.col("e") == e, F.col(c))).alias(f"{c}{e}") for e in range(4) for c in ("n", "b")]
    every = quarters.groupBy("a").agg(F.sum("t").alias("total"), *each)
    tops = F.sort_array(F.filter(F.array(*[F.struct(F.col(f"n{e}").alias("n"), F.col(f"b{e}").alias("b")) for e in range(4)]), lambda s: s["n"].isNotNull()), asc=False)
    top = lambda i, c: F.get("tops", F.lit(i))[c]
    return every.withColumn("tops", tops).select(F.col("a").alias("key"), "total", top(0, "b").alias("g1"), top(0, "n").alias("n1"), top(1, "b").alias("g2"), F.coalesce(top(1, "n"), F.lit(0).cast("bigint")).alias("n2"))


def bucket(n: Column) -> Column:
    return F.least(n, F.lit(FOLLOWERS)).cast("int")


def follower_odds(known: DataFrame) -> list[float]:
    """For each count of the expected passage, how likely it is right: over all training texts, each without itself."""
    stay = F.col("n1") - 1 >= F.col("n2")
    n1, n2, others = F.col("n1"), F.col("n2"), F.col("total") - F.col("n1")
    cases = F.array(
        F.struct(bucket(F.when(stay, n1 - 1).otherwise(n2)).alias("k"), F.when(stay, n1).otherwise(0).alias("right"), n1.alias("every")),  # texts that have the first
        F.struct(bucket(n1).alias("k"), F.lit(0).cast("bigint").alias("right"), others.alias("every")),  # and all others
    )
    rows = known.select(F.explode(cases).alias("c")).groupBy("c.k").agg(F.sum("c.right").alias("right"), F.sum("c.every").alias("every")).collect()
    seen = {r.k: (r.right, r.every) for r in rows}
    return [(seen.get(k, (0, 0))[0] + 0.5) / (seen.get(k, (0, 0))[1] + 1) for k in range(FOLLOWERS + 1)]


def score_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", folds: int = 5, held: int = 1) -> DataFrame:
    """Token statistics, unigram base and model score of every whole text."""
    spark = docs.sparkSession
    fold = F.when(crc_mod(id_col, folds) == held, -1).when(crc_mod(id_col, folds * MIX_FOLDS) < folds, 1).otherwise(0)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("binary"), F.lit(b"")).alias("_text"), fold.cast("int").alias("_fold"))
    counted = stored(corpus_counts(rows), "corpus")
    tokens, known = counted.filter("b IS NULL").select(F.col("a").alias("token"), F.col("n").alias("c")), stored(followers(counted.filter("b IS NOT NULL")), "followers")
    ends = rows.filter("_fold >= 0").count()
    words, kinds = tokens.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    total, distinct = words + ends, kinds + (ends > 0)
    frequent = [r.token % (1 << 64) for r in tokens.orderBy(F.desc("c"), "token").limit(FREQUENT).collect()]
    classes = gate_classes(rows, frequent)
    cut = stored(pieces_of(unit_counts(rows, classes)), "pieces")
    model = train(cut)
    divisor = total + 0.5 * (distinct + 1)
    units = score_units(cut, model).join(tokens, "token", "left")
    seen = F.coalesce("c", F.lit(0))
    scored = stored(
        units.select(
            "key", "n", "lp", F.when(F.col("worded"), F.log10((seen + 0.5) / F.lit(divisor))).otherwise(0.0).alias("base"), F.when(F.col("worded"), (seen > 0).cast("double")).otherwise(0.0).alias("known")
        ),
        "scored",
    )
    heavy = F.col("n") >= most_frequent(scored, HEAVY)
    common = scored.filter(heavy).select("key", "lp", "base", "known").toArrow()
    keys = common.column("key").to_numpy().view(np.uint64)
    order = np.argsort(keys)
    table = spark.sparkContext.broadcast((keys[order], *[common.column(c).to_numpy()[order].astype(np.float64) for c in ("lp", "base", "known")]))
    del common, keys, order
    kind = docs.schema[id_col].dataType.simpleString()

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, *values = table.value
        lookup, reader, row = Lookup(keys), Reader(classes), TaskContext.get().partitionId() << 33
        for batch in batches:
            ids, folds, sizes = batch.column(1), np.array(batch.column(2)), np.array(batch.column(3))
            none = pa.nulls(1, ids.type)
            for first, texts in slices(x.as_py() for x in batch.column(0)):
                r = reader.read(texts)
                n_texts = len(texts)
                mine = slice(first, first + n_texts)
                key = unit_key(r.unit, reader.gates(r))
                at = lookup.find(key)
                hit = at >= 0
                starts, ctx, own, passage = reader.passages(r)
                n_passages = int(passage[-1]) + 1
                home = passage[r.first]  # of each text, its first passage
                text = np.repeat(np.arange(n_texts), np.diff(np.append(home, n_passages)))
                lp, base, known = (np.bincount(passage[hit], x[at[hit]], n_passages) for x in values)
                # Rare units, once for each passage.
                (far, far_key), tf = summed([passage[~hit].astype(np.uint64), key[~hit]], np.ones(int((~hit).sum()), np.int64))
                far = far.astype(np.int64)
                number, code = row + text, 2 * (np.arange(n_passages) - home[text]) + (folds[mine][text] < 0)
                ahead, follows = mixed(number.astype(np.uint64)), np.zeros(n_passages, np.int64)  # a first passage has no context and a key that nothing has
                ahead[passage[starts]], follows[passage[starts]] = ctx, own.view(np.int64)
                of_text = row + np.arange(n_texts)
                tokens = np.bincount(r.text[r.worded()], minlength=n_texts) + 1
                yield block(number[far], code[far], far_key, tf, np.zeros(len(far)), none.take(pa.array(np.zeros(len(far), np.int64))))
                yield block(number, code, ahead, follows, lp, none.take(pa.array(np.zeros(n_passages, np.int64))))
                yield block(of_text, np.full(n_texts, -1), mixed(of_text.astype(np.uint64)), 2 * tokens + (folds[mine] < 0), np.bincount(text, base, n_texts), ids.slice(first, n_texts))
                yield block(of_text, np.full(n_texts, -2), mixed(of_text.astype(np.uint64)), sizes[mine], np.bincount(text, known, n_texts), none.take(pa.array(np.zeros(n_texts, np.int64))))
                row += n_texts

    def block(number, code, key, x, y, ids) -> pa.RecordBatch:
        columns = [pa.array(number.astype(np.int64)), pa.array(code.astype(np.int64)), pa.array(key.view(np.int64)), pa.array(x.astype(np.int64)), pa.array(y), ids]
        return pa.RecordBatch.from_arrays(columns, ["row", "code", "key", "x", "y", "doc_id"])

    # Rows of rare units (code from 0: passage and whether held out, x: how often), of passages (x: the passage, y: its frequent units), and two of each text (code -1: tokens and base, -2: bytes and known tokens).
    found = rows.select("_text", "doc_id", "_fold", F.octet_length("_text").cast("bigint").alias("size")).mapInArrow(read, f"row bigint, code bigint, key bigint, x bigint, y double, doc_id {kind}")
    none = lambda c: F.lit(None).cast(c)
    lookup = scored.filter(~heavy).select("key", "lp", "base", "known", none("bigint").alias("g1"), none("bigint").alias("n1"), none("bigint").alias("g2"), none("bigint").alias("n2")).unionByName(
        known.select("key", none("float").alias("lp"), none("double").alias("base"), none("double").alias("known"), "g1", "n1", "g2", "n2")
    )
    joined = found.join(lookup, "key", "left")
    odds = F.array(*[F.lit(p) for p in follower_odds(known)])
    own = F.when(F.pmod("code", F.lit(2)) == 1, 0).otherwise(1)
    one = F.col("n1") - own * (F.col("x") == F.col("g1")).cast("int")
    two = F.col("n2") - own * F.coalesce((F.col("x") == F.col("g2")).cast("int"), F.lit(0))
    count = F.greatest(one, two)
    right = F.col("x") == F.when(one >= two, F.col("g1")).otherwise(F.col("g2"))
    odd = F.get(odds, bucket(count))
    expected = F.col("n1").isNotNull() & (count > 0)
    inner = F.col("code") >= 0
    parts = joined.select(
        "row", "code", "doc_id", F.when(~inner, F.col("x")).alias("x"), F.when(~inner, F.col("y")).alias("y"),
        F.when(inner, F.col("y") + F.coalesce(F.col("x") * F.col("lp"), F.lit(0.0))).alias("lp"), F.when(expected & right, F.log10(odd)).alias("sure"), F.when(expected & ~right, F.log10(1 - odd)).alias("miss"),
        (F.col("x") * F.col("base")).alias("base"), (F.col("x") * F.col("known")).alias("known"),
    )
    passages = parts.repartition("row").groupBy("row", "code").agg(F.max("doc_id").alias("doc_id"), F.max("x").alias("x"), F.max("y").alias("y"), *[F.sum(c).alias(c) for c in ("lp", "miss", "base", "known")], F.max("sure").alias("sure"))
    lp = F.coalesce(F.col("sure"), F.col("lp") + F.coalesce("miss", F.lit(0.0)))
    of = lambda code, c: F.max(F.when(F.col("code") == code, F.col(c)))
    whole = passages.groupBy("row").agg(
        F.max("doc_id").alias("doc_id"), F.sum(F.when(inner, lp)).alias("lp"), F.coalesce(F.sum("base"), F.lit(0.0)).alias("base"), F.coalesce(F.sum("known"), F.lit(0.0)).alias("known"),
        of(-1, "x").alias("tokens"), of(-1, "y").alias("base0"), of(-2, "x").alias("bytes"), of(-2, "y").alias("known0"),
    )
    end = float(np.log10((ends + 0.5) / divisor))
    return whole.select(
        "doc_id",
        (F.pmod("tokens", F.lit(2)) == 1).alias("held_out"),
        F.shiftright("tokens", 1).alias("n_tokens"),
        (F.round(F.col("known0") + F.col("known")) + int(ends > 0)).cast("bigint").alias("n_known"),
        F.lit(total).cast("bigint").alias("train_tokens"),
        (F.col("base0") + F.col("base") + F.lit(end)).alias("base_score"),
        F.col("lp").alias("score"),
        (-F.col("lp") / F.lit(float(np.log10(2))) / F.greatest("bytes", F.lit(1))).alias("bits_per_byte"),
    )
