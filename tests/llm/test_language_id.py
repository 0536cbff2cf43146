"""Language identification against a plain version of profiles, ranks and distances."""

import zlib
from collections import Counter

from pyspark.sql import functions as F

from palaver.llm import language_id
from tests.llm.test_operators import SCHEMA, corpus

SIZE = 300


def plain_grams(text):
    """Counts of all n-grams of one to three places, words with a border at both ends."""
    words = "".join(c if c.isalpha() else " " for c in (text or "").lower()).split()
    found = Counter()
    for w in (f" {w} " for w in words):
        found.update(w[1:-1])
        found.update(w[i : i + 2] for i in range(len(w) - 1))
        found.update(w[i : i + 3] for i in range(len(w) - 2))
    return found


def ranked(counts):
    def packed(g):
        total = 0
        for c in g:
            total = total << 21 | ord(c)
        return total

    return sorted(counts, key=lambda g: (-counts[g], packed(g)))[:SIZE]


def plain_languages(rows):
    """(held out, language, score) of every row (doc_id, text, lang, ...), learnt from those that are not held out."""
    held = [zlib.crc32(str("" if r[0] is None else r[0]).encode()) % 4 == 2 for r in rows]
    counts = {}
    for r, out in zip(rows, held, strict=True):
        if not out and r[2] is not None and (found := plain_grams(r[1])):
            counts.setdefault(r[2], Counter()).update(found)
    profiles = {lang: {g: i for i, g in enumerate(ranked(c))} for lang, c in sorted(counts.items())}
    result = []
    for r, out in zip(rows, held, strict=True):
        own = ranked(plain_grams(r[1]))
        if not own or not profiles:
            result.append((out, "und", 0.0))
            continue
        apart = {lang: sum(min(SIZE, abs(i - p[g])) if g in p else SIZE for i, g in enumerate(own)) for lang, p in profiles.items()}
        best = min(apart, key=lambda lang: (apart[lang], lang))
        result.append((out, best, 1 - apart[best] / (SIZE * len(own))))
    return result


def test_languages_are_those_of_the_plain_version(spark):
    rows = corpus(90)
    rows += [(500, "Ünïcode Straße ÉTÉ naïve 中文字 кириллица", "de", "", 1), (501, "İstanbul ǅ ß", "tr", "", 1), (502, "the and of " * 60_000, "en", "", 1), (503, "a" * 300_000 + " b", None, "", 1), (504, "die\tder\ndas", "de", "", 1)]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(4).withColumns({"score": F.lit("clash"), "_p": F.lit("clash"), "lang_pred": F.lit("clash"), "held_out": F.lit(1)})
    got = sorted((str(r.doc_id), r.held_out, r.lang_pred, round(r.score, 9)) for r in language_id.identify(docs).collect())
    assert got == sorted((str(r[0]), out, lang, round(score, 9)) for r, (out, lang, score) in zip(rows, plain_languages(rows), strict=True))
