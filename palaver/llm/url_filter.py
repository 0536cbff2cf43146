"""Operator 6: URL rules as one bit-parallel wildcard automaton.

All glob rules are packed into words of 64 bits, one bit for each state. A step over a byte shifts
every pattern at once (Shift-And); a wildcard keeps its state's bit. In a glob ``*`` stands for
bytes other than ``/`` and ``**`` for any bytes; every other byte stands for itself.

Defined cases: a null URL, or one without ``://``, has empty host and path and fits no rule;
repeated rows are judged alike; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palaver.llm.common import ascii_lower

#: (host, path, verdict)
RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]


@dataclass(frozen=True)
class Automaton:
    """Masks over words of 64 states: steps and self-loops for each byte, and the accepting states."""

    start: np.ndarray
    step: np.ndarray
    loop: np.ndarray
    accept: list[tuple[int, int, int]]  # word, bit, pattern


def compile_globs(globs: list[bytes]) -> Automaton:
    """One automaton for all globs; patterns may straddle words, as the shift carries over."""
    literal: list[tuple[int, int]] = []  # state that a literal leads to, byte
    loops: list[tuple[int, bool]] = []
    starts, ends, state = [], [], -1
    for n, glob in enumerate(globs):
        state += 1
        starts.append(state)
        i = 0
        while i < len(glob):
            if glob[i : i + 1] == b"*":
                double = glob[i : i + 2] == b"**"
                loops.append((state, double))
                i += 2 if double else 1
            else:
                state += 1
                literal.append((state, glob[i]))
                i += 1
        ends.append((state, n))
    words = max(1, state // 64 + 1)
    start, step, loop = np.zeros(words, np.uint64), np.zeros((256, words), np.uint64), np.zeros((256, words), np.uint64)
    bit = [np.uint64(1) << np.uint64(k) for k in range(64)]
    for s in starts:
        start[s // 64] |= bit[s % 64]
    for s, byte in literal:
        step[byte, s // 64] |= bit[s % 64]
    for s, double in loops:
        for byte in range(256):
            if double or byte != ord("/"):
                loop[byte, s // 64] |= bit[s % 64]
    return Automaton(start, step, loop, [(s // 64, s % 64, n) for s, n in ends])


def first_match(automaton: Automaton, texts: pa.Array) -> np.ndarray:
    """For each text the smallest number of a glob that fits all of it, or -1.

    The texts of a batch advance together, longest first, so a step touches only those that still have bytes.
    """
    texts = texts.cast(pa.large_binary())
    n = len(texts)
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + n + 1]
    data = np.frombuffer(texts.buffers()[2], np.uint8) if texts.buffers()[2] is not None and texts.buffers()[2].size else np.zeros(1, np.uint8)
    lengths = np.diff(offsets)
    order = np.argsort(-lengths, kind="stable")
    lengths, begin = lengths[order], offsets[:-1][order]
    words = len(automaton.start)
    state = np.repeat(automaton.start[:, None], n, axis=1)
    alive = n
    for t in range(int(lengths[0]) if n else 0):
        alive = int(np.searchsorted(-lengths[:alive], -t, side="left"))  # those longer than t
        byte = data[begin[:alive] + t]
        now = state[:, :alive]
        moved = now << np.uint64(1)
        if words > 1:
            moved[1:] |= now[:-1] >> np.uint64(63)
        state[:, :alive] = (moved & automaton.step[byte].T) | (now & automaton.loop[byte].T)
    best = np.full(n, -1, np.int64)
    for word, bit, pattern in sorted(automaton.accept, key=lambda x: -x[2]):
        best[(state[word] >> np.uint64(bit)) & np.uint64(1) == 1] = pattern
    out = np.empty(n, np.int64)
    out[order] = best
    return out


def host_path(url: Column) -> tuple[Column, Column]:
    """Host (A to Z lower-cased) and path of a URL; both empty if it is null or has no ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    return ascii_lower(F.regexp_extract(rest, r"^([^/?#]*)", 1)), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def url_filter(pages: DataFrame, rules: list[tuple[str, str, str]] = RULES, default: str = "allow", id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """Verdict for every URL: the longest rule that fits host (or a parent domain) and path prefix, else ``default``.

    Each rule gives two globs, for the host itself and for its subdomains. Rules are few and fixed
    in the call, so the masks travel with the function.
    """
    ranked = sorted(rules, key=lambda r: -len(r[0] + r[1]))
    globs = [g for host, path, _ in ranked for g in (f"{host}{path}**".encode(), f"*.{host}{path}**".encode())]
    automaton = compile_globs(globs)

    @F.arrow_udf("int")
    def judge(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            found = first_match(automaton, batch)
            yield pa.array(np.where(found < 0, -1, found // 2), pa.int32())

    host, path = host_path(F.col(url_col))
    split = pages.select(F.col(id_col).alias("page_id"), host.alias("host"), path.alias("path"))
    names = F.array(*[F.lit(h + p) for h, p, _ in ranked])
    verdicts = F.array(*[F.lit(v) for _, _, v in ranked])
    return split.withColumn("_rule", judge(F.concat("host", "path").cast("binary"))).select(
        "page_id",
        "host",
        "path",
        F.when(F.col("_rule") >= 0, F.get(names, F.col("_rule"))).alias("rule"),
        F.when(F.col("_rule") >= 0, F.get(verdicts, F.col("_rule"))).otherwise(F.lit(default)).alias("verdict"),
    )


SQL = r"""
WITH u AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS (SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
      regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
r(h, x, v) AS (VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block')),
m AS (SELECT p.page_id, h || x AS rule, v FROM p JOIN r ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, x)
      QUALIFY row_number() OVER (PARTITION BY p.page_id ORDER BY length(h || x) DESC) = 1)
SELECT p.page_id, host, path, rule, coalesce(v, 'allow') AS verdict FROM p LEFT JOIN m USING (page_id)
"""
