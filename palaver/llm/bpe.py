"""Operator 3: byte-level BPE encoding by dynamic programming over prefixes, and decoding.

Every prefix of a piece has one encoding, so it has one last token. An automaton with suffix links
lists the vocabulary tokens that end at each byte; the one that is compatible with the last token of
the prefix before it is the last token of the longer prefix. Following the back-pointers from the end
gives exactly the ids that applying the merges in order gives, in time linear in the piece.

Defined cases: a null text is the empty text (no ids); texts of any length are encoded whole; repeated
rows give equal results; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed pattern that splits a text into pieces before merging.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Pieces kept with their ids by each Python worker; when full, the store starts anew.
MEMO = 300_000
ENDLESS = 1 << 60


#: Characters beyond the Latin letters for which latin_pattern() holds.
LATIN_END = 0x250
OTHER = re.compile(f"[^\\x00-{chr(LATIN_END - 1)}]")


def latin_pattern() -> str:
    """PIECES with its classes spelled out for the characters below LATIN_END."""

    def chars(kind: str) -> str:
        return "".join(f"\\u{c:04x}" for c in range(LATIN_END) if unicodedata.category(chr(c)).startswith(kind))

    letters, numbers = chars("L"), chars("N")
    space = "\\t-\\r \\x85\\xa0"
    return rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{letters}]+| ?[{numbers}]+| ?[^{space}{letters}{numbers}]+|[{space}]+(?![^{space}])|[{space}]+"


def byte_alphabet() -> dict[str, int]:
    """The characters that vocabulary files use for bytes: printable ones stand for themselves, the rest follow from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


def read_vocabulary(path: str) -> dict:
    """Token bytes by id, merges in order of rank, and special tokens of a tokenizer file."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    alphabet = byte_alphabet()
    ids = {bytes(alphabet[c] for c in token): i for token, i in spec["model"]["vocab"].items()}
    merges = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
    pairs = [(bytes(alphabet[c] for c in a), bytes(alphabet[c] for c in b)) for a, b in merges]
    special = {t["content"]: t["id"] for t in spec["added_tokens"]}
    return {"ids": {t: i for t, i in ids.items() if i not in set(special.values())}, "pairs": pairs, "special": special}


class Codec:
    """Encodes and decodes texts with one vocabulary."""

    def __init__(self, vocabulary: dict):
        ids = vocabulary["ids"]
        self.special = vocabulary["special"]
        self.rank: dict[tuple[int, int], int] = {}
        self.parts: dict[int, tuple[int, int, int]] = {}  # left, right, rank of the merge that makes the token
        for rank, (a, b) in enumerate(vocabulary["pairs"]):
            pair = (ids[a], ids[b])
            self.rank.setdefault(pair, rank)
            self.parts.setdefault(ids[a + b], (*pair, rank))
        self.automaton = ahocorasick.Automaton()
        for token, i in ids.items():
            self.automaton.add_word(token.decode("latin-1"), (len(token), i))
        self.automaton.make_automaton()
        self.fits: dict[int, bool] = {}  # by both ids, left one shifted by 32 bits
        self.edges: dict[tuple[int, bool], list[tuple[int, int]]] = {}
        self.memo: dict[str, bytes] = {}
        self.pattern, self.latin = regex.compile(PIECES), re.compile(latin_pattern())
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        size = max([*ids.values(), *self.special.values()]) + 1
        table = [b""] * size
        for token, i in ids.items():
            table[i] = token
        for token, i in self.special.items():
            table[i] = token.encode()
        self.lengths = np.array([len(t) for t in table], np.int64)
        self.starts = np.concatenate([[0], np.cumsum(self.lengths)])[:-1]
        self.bytes = np.frombuffer(b"".join(table), np.uint8)

    def edge(self, token: int, right: bool) -> list[tuple[int, int]]:
        """Tokens that stand at one end of ``token`` while it is being merged, oldest first, each with the rank of the merge that ends it."""
        known = self.edges.get((token, right))
        if known is None:
            known, ends, at = [], ENDLESS, token
            while True:
                known.append((at, ends))
                made = self.parts.get(at)
                if made is None:
                    break
                at, ends = made[1 if right else 0], made[2]
            known.reverse()
            self.edges[token, right] = known
        return known

    def compatible(self, left: int, right: int) -> bool:
        """Whether merging the bytes of both tokens side by side leaves exactly these two tokens.

        Plays the merges at the border in time: a merge across it comes first if its rank is below that of the next
        merge inside the left token, and not above that of the next inside the right one (equal ranks go from the left).
        """
        a, b = self.edge(left, True), self.edge(right, False)
        i = j = 0
        if len(self.fits) > 1_000_000:
            self.fits.clear()
        while True:
            (x, x_ends), (y, y_ends) = a[i], b[j]
            across = self.rank.get((x, y), ENDLESS)
            if across < x_ends and across <= y_ends:
                return False
            if x_ends == ENDLESS and y_ends == ENDLESS:
                return True
            if x_ends <= y_ends:
                i += 1
            else:
                j += 1

    def encode_piece(self, piece: bytes) -> list[int]:
        """Ids of one piece: last token of every prefix, then back from the end.

        The automaton gives the tokens that end at a byte from the longest to the shortest.
        """
        size = len(piece)
        last, length_of = [-1] * (size + 1), [0] * (size + 1)
        fits = self.fits
        for end, (length, token) in self.automaton.iter(piece.decode("latin-1")):
            end += 1
            if last[end] >= 0:
                continue
            start = end - length
            if start:
                pair = last[start] << 32 | token
                fit = fits.get(pair)
                if fit is None:
                    fit = fits[pair] = self.compatible(last[start], token)
                if not fit:
                    continue
            last[end], length_of[end] = token, length
        ids, end = [], size
        while end:
            ids.append(last[end])
            end -= length_of[end]
        return ids[::-1]

    def split(self, text: str) -> list[str]:
        """Pieces of a text; the pattern with explicit classes is faster and serves texts without other letters."""
        return (self.pattern if OTHER.search(text) else self.latin).findall(text)

    def encode(self, text: str) -> np.ndarray:
        """Ids of a whole text; strings of special tokens in it become those tokens."""
        out = []
        for part in self.cut.split(text) if self.cut else [text]:
            if part in self.special:
                out.append(np.array([self.special[part]], "<u4").tobytes())
                continue
            for piece in self.split(part):
                ids = self.memo.get(piece)
                if ids is None:
                    if len(self.memo) >= MEMO:
                        self.memo.clear()
                    ids = self.memo[piece] = np.array(self.encode_piece(piece.encode()), "<u4").tobytes()
                out.append(ids)
        return np.frombuffer(b"".join(out), "<u4")

    def decode(self, ids: np.ndarray) -> str:
        """Text of ids, special tokens included; bytes that are no UTF-8 become U+FFFD."""
        lengths = self.lengths[ids]
        ends = np.cumsum(lengths)
        total = int(ends[-1]) if len(ends) else 0
        at = np.repeat(self.starts[ids] - (ends - lengths), lengths) + np.arange(total)
        return self.bytes[at].tobytes().decode("utf-8", "replace")


_CODECS: dict[int, Codec] = {}


def worker_codec(shared) -> Codec:
    """The codec of this Python worker, built once from the broadcast vocabulary."""
    key = shared.value["digest"]
    if key not in _CODECS:
        _CODECS.clear()
        _CODECS[key] = Codec(shared.value)
    return _CODECS[key]


def share_vocabulary(spark, path: str):
    """Broadcast of the vocabulary; its size is that of the file, whatever the corpus."""
    vocabulary = read_vocabulary(path)
    vocabulary["digest"] = hashlib.sha256(repr(sorted(vocabulary["ids"].items())).encode()).hexdigest()
    return spark.sparkContext.broadcast(vocabulary)


def bpe_encode(docs: DataFrame, path: str, text_col: str = "text", out: str = "ids") -> DataFrame:
    """``docs`` with the column ``out``: the ids of each whole text."""
    shared = share_vocabulary(docs.sparkSession, path)

    @F.arrow_udf("array<int>")
    def ids(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        codec = worker_codec(shared)
        for batch in batches:
            found = [codec.encode(t.as_py() or "") for t in batch]
            offsets = np.concatenate([[0], np.cumsum([len(x) for x in found])]).astype(np.int32)
            yield pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([np.zeros(0, "<u4"), *found]).astype(np.int32)))

    return docs.withColumn(out, ids(F.col(text_col).cast("string")))


def bpe_decode(docs: DataFrame, path: str, ids_col: str = "ids", out: str = "decoded") -> DataFrame:
    """``docs`` with the column ``out``: the text of each list of ids (null ids: empty text)."""
    shared = share_vocabulary(docs.sparkSession, path)

    @F.arrow_udf("string")
    def text(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        codec = worker_codec(shared)
        for batch in batches:
            yield pa.array([codec.decode(np.array(x.as_py() or [], np.int64)) for x in batch], pa.string())

    return docs.withColumn(out, text(F.col(ids_col)))


def bpe_digest(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Number of tokens and digests of ids and of the decoded text, in one pass that ships no ids back to the JVM."""
    shared = share_vocabulary(docs.sparkSession, path)

    @F.arrow_udf("struct<n_tokens:bigint,ids_sha256:string,decoded_sha256:string>")
    def digest(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        codec = worker_codec(shared)
        for batch in batches:
            counts, of_ids, of_text = [], [], []
            for t in batch:
                ids = codec.encode(t.as_py() or "")
                counts.append(len(ids))
                of_ids.append(hashlib.sha256(ids.tobytes()).hexdigest())
                of_text.append(hashlib.sha256(codec.decode(ids).encode()).hexdigest())
            yield pa.StructArray.from_arrays([pa.array(counts, pa.int64()), pa.array(of_ids, pa.string()), pa.array(of_text, pa.string())], ["n_tokens", "ids_sha256", "decoded_sha256"])

    found = docs.select(F.col(id_col).alias("doc_id"), digest(F.col(text_col).cast("string")).alias("_d"))
    return found.select("doc_id", "_d.n_tokens", "_d.ids_sha256", "_d.decoded_sha256")
