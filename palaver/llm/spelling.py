"""Operator 12: spelling variants by composition of finite-state machines.

The words of a corpus are counted; two are near if one edit (a code point inserted, deleted or replaced) turns one into the other. With A the minimised acceptor of
the vocabulary and E the one-edit transducer, the pairs that A o E o A accepts are enumerated. Up to the edit both sides of a pair read the same, so they are in one state of A;
beyond it they must end alike, which is the intersection of the languages of two states, worked out once for a pair of states. The edits at a state depend on that state alone and are worked out once, too.

No machine holds the whole vocabulary. Of a pair whose shorter word has ``l`` code points, either the first ``l // 2`` are the same or the last ``l - l // 2``, so words are dealt to partitions
by (l, these code points), each with an acceptor of its own that starts in the state behind the shared part. A partition of more than ``LIMIT`` words, or
whose words differ in more than ``FREE`` places, is dealt again: the free part is halved, and either its first half is the same or its second. So a partition ends with few words, or with a free part of
one or two code points, whose number of words the alphabet bounds. A pair that shares both halves is only found under the first.

A word's form is its near word that occurs most, if at least ``RATIO`` times as often as itself; counts at least double along forms, so they end, and roots are found by doubling pointers.

Defined cases: a null or empty text has no words; a null id counts as the empty text in the hash. Texts and runs of any length are read whole. Repeated rows count again. Of equal counts the smallest word in
code-point order is the form. Other columns, whatever their names, are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palaver.llm.common import runs, settle, stored

#: Runs of letters after A to Z are lower-cased.
RUN = re.compile("[a-zÀ-ÿ]+")
#: One in so many runs, by its hash with the id, loses a code point.
DAMAGE = 97
SHORTEST, FEWEST, RATIO = 5, 3, 2
LIMIT, FREE = 4096, 32
#: Distinct words that a task counts, or words whose partners it adds up, before it sends them on.
HELD = 1 << 17
ROW = "key bigint, l int, a int, c int, word string, n bigint"


def damaged(word: str, crc: int) -> str:
    """``word`` without a code point if the hash says so; ``crc`` is that of the text before it."""
    h = zlib.crc32(word.encode(), crc)
    if h % DAMAGE:
        return word
    i = h % len(word)
    return word[:i] + word[i + 1 :]


def words_of(doc_id: str | None, text: str | None) -> Counter:
    """How often the words of at least ``SHORTEST`` code points occur in one text."""
    found: Counter = Counter()
    # The hash is that of the id and the run, so equal runs of a text are damaged alike.
    crc = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
    for word, n in Counter(m[0] for m in RUN.finditer((text or "").encode("utf-8", "replace").lower().decode())).items():
        if len(word) >= SHORTEST and len(word := damaged(word, crc)) >= SHORTEST:
            found[word] += n
    return found


def vocabulary(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", fewest: int = FEWEST) -> DataFrame:
    """(word, n): the words that occur at least ``fewest`` times."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()

        def out() -> pa.RecordBatch:
            rows = pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())], ["word", "n"])
            held.clear()
            return rows

        for batch in batches:
            for doc_id, text in zip(batch.column(0), batch.column(1), strict=True):
                held.update(words_of(doc_id.as_py(), text.as_py()))
                if len(held) >= HELD:
                    yield out()
        yield out()

    each = docs.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(count, "word string, n bigint")
    return each.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= fewest)


class Acceptor:
    """The minimised acyclic acceptor of some sorted strings; a state is a number, and what can follow it is told apart by length."""

    def __init__(self, strings: list[str]):
        self.final: list[bool] = []
        self.arcs: list[dict[str, int]] = []
        self.lengths: list[int] = []  # bit r: a string of r code points is accepted from here
        self.register: dict[tuple, int] = {}
        self.common: dict[tuple[int, int, int], list[str]] = {}
        self.edited: dict[tuple[int, int], list[tuple[str, str]]] = {}
        self.start = self._state(strings, 0, len(strings), 0)

    def _state(self, strings: list[str], i: int, j: int, depth: int) -> int:
        """The state of the strings from ``i`` to ``j``, which have their first ``depth`` code points in common. Equal states are one."""
        final = len(strings[i]) == depth
        i += final
        arcs = {}
        while i < j:
            c, k = strings[i][depth], i + 1
            while k < j and strings[k][depth] == c:
                k += 1
            arcs[c] = self._state(strings, i, k, depth + 1)
            i = k
        known = (final, *arcs.items())
        if (found := self.register.get(known)) is None:
            found = self.register[known] = len(self.arcs)
            self.final.append(final)
            self.arcs.append(arcs)
            mask = int(final)
            for s in arcs.values():
                mask |= self.lengths[s] << 1
            self.lengths.append(mask)
        return found

    def alike(self, p: int, q: int, r: int) -> list[str]:
        """The strings of ``r`` code points that are accepted from both states."""
        if not (self.lengths[p] & self.lengths[q]) >> r & 1:
            return []
        if not r:
            return [""]
        key = (p, q, r) if p <= q else (q, p, r)
        if (found := self.common.get(key)) is None:
            one, two = self.arcs[p], self.arcs[q]
            found = self.common[key] = [c + t for c, s in one.items() if c in two for t in self.alike(s, two[c], r - 1)]
        return found

    def edits(self, p: int, r: int, at_end: bool) -> list[tuple[str, str]]:
        """Pairs of strings from state ``p`` on that differ by one edit right here; the first has ``r`` code points.

        Replaced: both go on alike behind different arcs. Inserted: the second reads one arc more, and what follows does not begin with the same code point, so an
        insertion into a run of one code point counts once; ``at_end`` allows it behind the last one.
        """
        if (found := self.edited.get((p, r))) is None:
            found, arcs = [], list(self.arcs[p].items())
            if r and self.lengths[p] >> r & 1:
                for k, (x, s) in enumerate(arcs):
                    if self.lengths[s] >> (r - 1) & 1:
                        for y, t in arcs[k + 1 :]:
                            found += [(x + z, y + z) for z in self.alike(s, t, r - 1)]
            if r or at_end:
                for y, t in arcs:
                    found += [(z, y + z) for z in self.alike(p, t, r) if z[:1] != y]
            self.edited[p, r] = found
        return found

    def pairs(self, size: int, at_end: bool) -> Iterator[tuple[str, str]]:
        """Accepted pairs one edit apart, the first of ``size`` code points and the second not shorter."""
        stack = [(self.start, "")]
        while stack:
            p, read = stack.pop()
            left = size - len(read)
            for u, v in self.edits(p, left, at_end):
                yield read + u, read + v
            if left:
                stack.extend((s, read + c) for c, s in self.arcs[p].items())


def partners(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(word, near, best_n, best) of all partitions of a task, sorted by key: how many partners a word has there, and the one that occurs most."""
    held: dict[str, list] = {}

    def add(x: str, y: str, n: int) -> None:
        if (now := held.get(x)) is None:
            held[x] = [1, -n, y]
        else:
            now[0] += 1
            if (-n, y) < (now[1], now[2]):
                now[1:] = -n, y

    def out() -> pa.RecordBatch:
        near, less, best = zip(*held.values(), strict=True) if held else ((), (), ())
        rows = pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.string()), pa.array(near, pa.int64()), pa.array(less, pa.int64()), pa.array(best, pa.string())], ["word", "near", "less", "best"])
        held.clear()
        return rows

    for key, *rest in runs(batches):
        new = np.flatnonzero(key[1:] != key[:-1]) + 1
        for i, j in zip([0, *new.tolist()], [*new.tolist(), len(key)], strict=True):
            if j - i < 2:
                continue
            # A key is a hash; what it stands for tells the partitions apart.
            parts: dict[tuple, dict[str, tuple[str, int]]] = {}
            for l, a, c, word, n in zip(*(x[i:j].tolist() for x in rest), strict=True):  # noqa: E741
                end = len(word) - c
                parts.setdefault((l, a, c, word[:a], word[end:]), {})[word[a:end]] = word, n
            for (l, a, c, _, _), free in parts.items():  # noqa: E741
                for u, v in Acceptor(sorted(free)).pairs(l - a - c, not c):
                    (x, n), (y, m) = free[u], free[v]
                    add(x, y, m)
                    add(y, x, n)
            if len(held) >= HELD:
                yield out()
    yield out()


def keyed(rows: DataFrame) -> DataFrame:
    """``rows`` (l, a, c, word, n) with the key of their partition: words of ``l`` or one more code points that share the first ``a`` and the last ``c``."""
    shared = [F.expr("substring(word, 1, a)"), F.expr("substring(word, length(word) - c + 1, c)")]
    return rows.select(F.xxhash64("l", "a", "c", *shared).alias("key"), "l", "a", "c", "word", "n")


def partitions(words: DataFrame, limit: int = LIMIT, free: int = FREE) -> DataFrame:
    """Rows (key, l, a, c, word, n) of all partitions, each of at most ``limit`` words unless its free part can't be halved."""
    half = "transform(filter(array(length(word), length(word) - 1), l -> l >= {0}), l -> array(struct(l, l div 2 AS a, 0 AS c), struct(l, 0 AS a, l - l div 2 AS c)))"
    rows = words.select(F.explode(F.flatten(F.expr(half.format(SHORTEST)))).alias("p"), "word", "n")
    rows, done = keyed(rows.select(F.col("p.l").cast("int").alias("l"), F.col("p.a").cast("int").alias("a"), F.col("p.c").cast("int").alias("c"), "word", "n")), []
    while True:
        size = F.max(F.col("l") - F.col("a") - F.col("c"))
        large = settle(rows.groupBy("key").agg(F.count("*").alias("count"), size.alias("f")).filter((F.col("count") > 1) & (F.col("f") > 1) & ((F.col("count") > limit) | (F.col("f") > free))).select("key"))
        if large.isEmpty():
            break
        done.append(rows.join(large, "key", "left_anti"))
        # The free part of the shorter words runs from a to l - c; m is its middle.
        middle = F.expr("a + (l - a - c + 1) div 2").cast("int")
        both = F.array(F.struct(F.col("m").alias("a"), "c"), F.struct("a", (F.col("l") - F.col("m")).alias("c")))
        rows = rows.join(large, "key", "left_semi").withColumn("m", middle).select("l", F.explode(both).alias("p"), "word", "n")
        rows = stored(keyed(rows.select("l", "p.a", "p.c", "word", "n")), "partitions")
    for other in done:
        rows = rows.unionByName(other)
    return rows


def roots_of(forms: DataFrame) -> DataFrame:
    """(word, root) of rows (word, form): forms followed to the last one, twice as far in every round."""
    now = settle(forms.select("word", F.col("form").alias("root")))
    while True:
        further = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        after = settle(now.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        if after.filter("moved").isEmpty():
            return after.select("word", "root")
        now = after.select("word", "root")


def variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", fewest: int = FEWEST, ratio: int = RATIO) -> DataFrame:
    """word, form, root, n, n_near and form_n of every word."""
    words = stored(vocabulary(docs, id_col, text_col, fewest), "words")
    dealt = partitions(words).repartition("key").sortWithinPartitions("key")
    near = dealt.mapInArrow(partners, "word string, near bigint, less bigint, best string")
    near = near.groupBy("word").agg(F.sum("near").alias("n_near"), F.min(F.struct("less", "best")).alias("b"))
    known = words.join(near, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"), F.when(-F.col("b.less") >= ratio * F.col("n"), F.col("b")).alias("b"))
    known = stored(known.select("word", F.col("b.best").alias("form"), "n", "n_near", (-F.col("b.less")).alias("form_n")), "forms")
    roots = roots_of(known.filter("form IS NOT NULL").select("word", "form"))
    return known.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
