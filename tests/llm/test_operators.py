"""Each dealt operator against a brute-force version on a small fixture, with the awkward rows: nulls, empties, repeats and clashing columns."""

import hashlib
import json
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from palaver.llm import bpe, chat_format, context_mixing, decontaminate, language_id, licences, near_copies, registry, search, sharding, simhash, url_filter

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def corpus(n=60, seed=3):
    rng = random.Random(seed)
    kinds = {"en": ["the", "of", "and", "then", "house", "shining", "ing", "wh"], "de": ["der", "und", "schön", "über", "heit", "lich", "zu", "ein"], "fr": ["le", "de", "été", "ment", "eux", "que", "une", "ç"]}
    rows = []
    for i in range(n):
        lang = rng.choice(list(kinds))
        words = ["".join(rng.choice(kinds[lang]) for _ in range(rng.randint(1, 2))) for _ in range(rng.randint(1, 80))]
        rows.append((i, " ".join(words).capitalize() + rng.choice([".", "\n", "!"]), lang, f"s{i % 3}", None))
    rows += [(n, rows[3][1], "en", "copy", 1), (n + 1, rows[3][1] + " end", "en", "near", 1), (n + 2, None, "en", None, None), (n + 3, "", None, "", 0), (n + 4, "  \t\n ", "de", "", 0), (n + 5, "12 34 !!", None, "", 0), (n + 6, "x" * 5000, "en", "", 1), (None, "null id text here", "fr", "", 1)]
    rows += [rows[5], rows[5]]
    return rows


@pytest.fixture(scope="module")
def docs(spark):
    clash = ("fp", "key", "shard", "slot", "score", "lang_pred", "_p", "_kept", "_hits", "component_id", "node")
    return spark.createDataFrame(corpus(), SCHEMA).withColumns({c: F.lit("clash") for c in clash}).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_jump_hash_is_consistent_and_even():
    keys = np.arange(20000)
    before, after = sharding.jump_hash(keys, 40), sharding.jump_hash(keys, 41)
    moved = before != after
    assert set(after[moved]) == {40} and 0.01 < moved.mean() < 0.04
    assert np.bincount(before).min() > 350
    assert sharding.jump_hash(np.array([0, 1, 2, 10863919174838991, 256]), 1).tolist() == [0] * 5


def test_jump_hash_equals_scalar_form():
    def scalar(key, n):
        b, j = -1, 0
        while j < n:
            b = j
            key = (key * 2862933555777941757 + 1) % 2**64
            j = int((b + 1) * (float(1 << 31) / ((key >> 33) + 1)))
        return b

    keys = [0, 1, 5, 2**63 - 1, 123456789]
    assert sharding.jump_hash(np.array(keys), 40).tolist() == [scalar(k, 40) for k in keys]


def test_sharding(docs, empty):
    got = sharding.assign_shards(docs, 5, rows_a_block=3).collect()
    want = Counter((r[0], len((r[1] or "").encode()) + 16, zlib.crc32((r[1] or "").encode())) for r in corpus())
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in got) == want
    for s in {r.shard for r in got}:
        slots = sorted(r.slot for r in got if r.shard == s)
        assert slots == list(range(len(slots)))
    assert all(r.grown_shard in (r.shard, 5) and r.law == "key" for r in got)
    assert sharding.assign_shards(empty).count() == 0


URLS = ["http://a.org/x", "https://Example.ORG/es/1?q", "http://www.example.org/en/12", "http://example.com/fr/", "http://x.com/de/a#b", "http://xcom/de/", "http://org", "ftp://org/", "no scheme", None, "", "http://evil.net/example.org/es/", "http://example.com/x.org/y", "x://é.org/é", "http://a.org/" + "z" * 3000, "http://HOST.com/FR/"]


def brute_url(url):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fits = [(h + p, v) for h, p, v in url_filter.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    rule, verdict = max(fits, key=lambda f: len(f[0])) if fits else (None, "allow")
    return host, path, rule, verdict


def test_url_filter(spark):
    pages = spark.createDataFrame([(i, u, "h") for i, u in enumerate(URLS * 2)], "page_id bigint, url string, host string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.url_filter(pages).collect()}
    assert got == {i: brute_url(u) for i, u in enumerate(URLS * 2)}
    assert url_filter.url_filter(pages.limit(0)).count() == 0


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text("ab/*", max_size=6), min_size=1, max_size=12), st.lists(st.text("ab/", max_size=40), min_size=1, max_size=12))
def test_automaton_equals_regex(globs, texts):
    import pyarrow as pa

    got = url_filter.first_match(url_filter.compile_globs([g.encode() for g in globs]), pa.array([t.encode() for t in texts], pa.binary()))
    as_regex = lambda g: "".join(".*" if x == "**" else "[^/]*" if x == "*" else re.escape(x) for x in re.findall(r"\*\*|.", g))
    want = [next((i for i, g in enumerate(globs) if re.fullmatch(as_regex(g), t, re.S)), -1) for t in texts]
    assert got.tolist() == want


@pytest.fixture(scope="module")
def codec():
    return bpe.Codec(bpe.read_vocabulary(VOCABULARY))


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(VOCABULARY)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(st.text(max_size=8), st.sampled_from(["the", " ", "  ", "\n", "<|endoftext|>", "'s", "ing", "été", "123", "aaaa", "\u00a0", "ǅ", "²"])), max_size=12))
def test_bpe_equals_library(codec, library, parts):
    text = "".join(parts).encode("utf-8", "ignore").decode()
    ids = codec.encode(text)
    assert ids.tolist() == library.encode(text, add_special_tokens=False).ids
    assert codec.decode(ids) == library.decode(ids.tolist(), skip_special_tokens=False)


def test_bpe_long_pieces(codec, library):
    for text in ("a" * 3000, "ab" * 2000, "é" * 1500, "!" * 2000, " " * 999, "9" * 500):
        assert codec.encode(text).tolist() == library.encode(text, add_special_tokens=False).ids


def test_bpe_decodes_broken_bytes(codec, library):
    ids = np.array([library.token_to_id("Ã"), 220, 50256])
    assert codec.decode(ids) == library.decode(ids.tolist(), skip_special_tokens=False)


def test_bpe_columns(docs, empty, library):
    for r in bpe.bpe_digest(docs, VOCABULARY).join(docs.select("doc_id", "text").distinct(), "doc_id").collect():
        ids = library.encode(r.text or "", add_special_tokens=False).ids
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256((r.text or "").encode()).hexdigest()
    there = bpe.bpe_decode(bpe.bpe_encode(docs, VOCABULARY), VOCABULARY)
    assert there.filter("decoded <> coalesce(text, '')").count() == 0 and bpe.bpe_digest(empty, VOCABULARY).count() == 0


def brute_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + 3]).encode(), 42) for i in range(max(1, len(words) - 2))]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def brute_components(fps):
    """Root of every fingerprint by comparing all pairs."""
    parent = {f: f for f in fps}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    some = list(parent)
    for i, a in enumerate(some):
        for b in some[i + 1 :]:
            if (a ^ b).bit_count() <= 3:
                parent[find(a)] = find(b)
    return {f: find(f) for f in some}


def test_simhash(docs, empty):
    rows = corpus()
    fps = [brute_fingerprint(r[1]) for r in rows]
    roots = brute_components(set(fps))
    least = {}
    for r, f in zip(rows, fps):
        if r[0] is not None:
            least[roots[f]] = min(least.get(roots[f], 1 << 60), r[0])
    want = Counter((r[0], f"{f:016x}", least.get(roots[f])) for r, f in zip(rows, fps))
    assert Counter(tuple(r) for r in simhash.simhash_groups(docs).collect()) == want
    assert simhash.simhash_groups(empty).count() == 0
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns and Counter(r.doc_id for r in kept.collect()) == Counter({*least.values(), None})  # the null id is alone in its component


def test_rows_without_id_are_kept_apart(spark):
    rows = [(None, "alpha beta gamma delta"), (None, "alpha beta gamma delta"), (None, "quite another text here"), (7, "one two three"), (None, "one two three"), (9, None)]
    kept = simhash.keep_one(spark.createDataFrame(rows, "doc_id bigint, text string"))
    assert Counter(map(tuple, kept.collect())) == Counter([rows[0], rows[2], rows[3], rows[5]])


@pytest.mark.parametrize("tile", [4, 4096])
def test_simhash_links_in_dense_groups(spark, tile):
    rng = random.Random(9)
    fps = {rng.getrandbits(64) for _ in range(50)}
    for centre in list(fps)[:4]:
        for _ in range(60):
            f = centre
            for b in rng.sample(range(64), rng.randint(1, 5)):
                f ^= 1 << b
            fps.add(f)
    signed = [(f - (1 << 64) if f >> 63 else f,) for f in fps]
    links = simhash.fingerprint_links(spark.createDataFrame(signed, "fp bigint"), tile)
    got = {r.node % 2**64: r.root % 2**64 for r in simhash.components(links).collect()}
    roots = brute_components(fps)
    groups = lambda m: {frozenset(x for x in m if m[x] == v) for v in set(m.values())}
    assert {g for g in groups(roots) if len(g) > 1} == groups(got)


def test_components_of_a_path(spark):
    links = spark.range(0, 40).selectExpr("id AS a", "id + 1 AS b")
    assert {r.root for r in simhash.components(links).collect()} == {0}
    assert simhash.components(links.limit(0)).count() == 0


def test_language_id(docs, empty):
    got = language_id.identify(docs)
    assert got.columns == ["doc_id", "held_out", "lang_pred", "score"]
    rows = {r[0]: r for r in corpus()}
    right = total = 0
    for r in got.collect():
        text, lang = rows[r.doc_id][1:3]
        assert r.held_out == (zlib.crc32(("" if r.doc_id is None else str(r.doc_id)).encode()) % 4 == 2) and 0 <= r.score <= 1
        if not any(c.isalpha() for c in text or ""):
            assert (r.lang_pred, r.score) == ("und", 0.0)
        elif r.doc_id is not None and r.doc_id < 60:
            right, total = right + (r.lang_pred == lang), total + 1
    assert right / total > 0.9
    assert language_id.identify(empty).count() == 0
    assert {r.lang_pred for r in language_id.identify(docs.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}
    kept = language_id.keep_identified(docs)
    assert kept.columns == docs.columns and kept.count() == docs.count() - 4


def test_language_profiles_by_hand():
    codes = language_id.code_points(b"Ab, c")
    assert "".join(map(chr, codes)) == " ab c "
    packed = lambda s: sum(ord(c) << 21 * (len(s) - 1 - i) for i, c in enumerate(s))
    assert sorted(language_id.grams(codes).tolist()) == sorted(packed(g) for g in ["a", "b", "c", " a", "ab", "b ", " c", "c ", " ab", "ab ", " c "])


ITEMS = [(1, "What is the tallest of all the old houses in town? The red one by the northern river bank stands tallest."), (2, "Short one"), (3, None), (4, "Name the capital city of the most eastern province.\nIt is the quiet harbour town of Lund near the sea."), (5, "What is the tallest of all the old houses in town? The red one by the northern river bank stands tallest.")]


def test_decontamination(spark, empty):
    text = {i: t for i, t in ITEMS}
    filler = " ".join(f"word{i % 40}" for i in range(300))
    rows = [(1, f"{filler} {text[1]} {filler}"), (2, filler), (3, text[4].upper()), (4, None), (5, ""), (6, text[1].replace("tallest", "oldest").replace("red", "blue")), (7, "Name the capital city of the most eastern province."), (8, text[4] + " " + text[1]), (8, text[4])]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").withColumns({"item_id": F.lit(1), "_hits": F.lit(2), "lang": F.lit("x")})
    bench = spark.createDataFrame(ITEMS, "item_id bigint, text string").withColumn("df", F.lit(0))
    got = Counter((r.doc_id, r.item_id) for r in decontaminate.contamination(docs, bench).collect())
    assert got == Counter([(1, 1), (1, 5), (3, 4), (8, 4), (8, 1), (8, 5), (8, 4)])
    kept = decontaminate.keep_clean(docs, bench)
    assert sorted(r.doc_id for r in kept.collect()) == [2, 4, 5, 6, 7] and kept.columns == docs.columns
    assert decontaminate.keep_clean(docs, bench.limit(0)).count() == len(rows)
    assert decontaminate.contamination(empty, bench).count() == 0


def test_decontamination_retrieval_is_exact():
    """Block-max retrieval returns just the (text, item) pairs whose score reaches the threshold, by scoring all windows."""
    rng = random.Random(1)
    vocabulary = [f"t{i}".encode() for i in range(60)]
    items = [(i, b" ".join(rng.choice(vocabulary) for _ in range(rng.randint(5, 30)))) for i in range(30)]
    df = Counter(t for _, x in items for t in set(x.split()))
    rows = [(i, x, [(t, math.log1p((30 - df[t] + 0.5) / (df[t] + 0.5))) for t in sorted(set(x.split()))]) for i, x in items]
    texts = [b" ".join(rng.choice(vocabulary) for _ in range(rng.randint(0, 150))).split() for _ in range(12)] + [items[4][1].split()]
    tokens, ends = sum(texts, []), np.cumsum([len(t) for t in texts])
    for index in decontaminate.build(rows, 0.6):
        got = {(d, i) for d, i, *_ in decontaminate.retrieve(index, tokens, ends, 0.0)}
        want = set()
        names = {v: k for k, v in index.terms.items()}
        for d, t in enumerate(texts):
            for start in range(0, max(1, len(t)), index.reach):
                window = set(t[start : start + 2 * index.reach])
                for block in index.items:
                    for item, terms, impacts, *_ in block:
                        if sum(x for n, x in zip(terms.tolist(), impacts.tolist()) if names[n] in window) >= 1 - 1e-9:
                            want.add((d, item))
        assert got == want


def brute_top(docs, query, k):
    tf = [Counter(search.words((t or "").encode())) for _, t in docs]
    n, mean, df = len(docs), sum(sum(c.values()) for c in tf) / len(docs), Counter(t for c in tf for t in c)
    out = []
    for (i, _), c in zip(docs, tf):
        s = sum(math.log1p((n - df[t] + 0.5) / (df[t] + 0.5)) * c[t] * 2.2 / (c[t] + 1.2 * (0.25 + 0.75 * sum(c.values()) / mean)) for t in set(search.words(query.encode())) if t in c)
        if s:
            out.append((-round(s, 9), i is None, i))
    return [x[2] for x in sorted(out)[:k]]


def test_search_is_exact(docs, empty, spark):
    rows = corpus()
    queries = [(1, rows[3][1]), (2, "the unknown schön"), (3, ""), (4, None), (5, "x" * 5000), (6, rows[5][1])]
    asked = spark.createDataFrame(queries, "query_id bigint, text string").withColumns({c: F.lit("x") for c in ("term", "round", "shard", "idf")})
    for shard_bytes, block in ((16 << 20, 4096), (2000, 2)):
        found = search.top_k(docs.withColumns({c: F.lit("x") for c in ("ids", "sizes", "round", "docs")}), asked, 5, shard_bytes=shard_bytes, block=block).collect()
        for q, text in queries:
            got = [r.doc_id for r in sorted((r for r in found if r.query_id == q), key=lambda r: r["rank"])]
            assert got == brute_top([r[:2] for r in rows], text or "", 5)
    assert search.like_texts(empty).count() == 0


def test_search_takes_very_long_texts(spark):
    rng = random.Random(2)
    rows = [(i, " ".join(f"w{min(int(rng.expovariate(0.01)), 900)}" for _ in range(n))) for i, n in enumerate([40_000, 3, 500, 60, 20_000] + [50] * 40)]
    found = search.top_k(spark.createDataFrame(rows, "doc_id bigint, text string"), spark.createDataFrame([(1, rows[0][1]), (2, rows[7][1])], "query_id bigint, text string"), 4, shard_bytes=5000).collect()
    for q, text in ((1, rows[0][1]), (2, rows[7][1])):
        assert [r.doc_id for r in sorted((r for r in found if r.query_id == q), key=lambda r: r["rank"])] == brute_top(rows, text, 4)


def test_pruning_drops_nothing_wanted():
    rng = random.Random(5)
    texts = [" ".join(f"w{min(int(rng.expovariate(0.05)), 200)}" for _ in range(rng.randint(1, 60))).encode() for _ in range(700)]
    row = search.packed(0, list(range(700)), [search.term_counts(t) for t in texts]).to_pylist()[0]
    row = {k: pa.scalar(v, pa.list_(pa.int64()) if k == "ids" else None) for k, v in row.items()}
    for n in range(30):
        terms = sorted(search.term_counts(" ".join(f"w{rng.randint(0, 150)}" for _ in range(rng.randint(1, 40))).encode())[0].tolist())
        idf = np.array([rng.uniform(0.1, 6) for _ in terms])
        asked = search.Asked(np.array([1]), np.array([0, len(terms)]), np.arange(len(terms), dtype=np.int32), np.array(terms, np.uint64), idf, np.zeros(1))
        shard = search.Shard(row, asked, 30.0)
        every, scores = shard.top(asked.places, 0.0, 700)
        for at in (0, 9, 40):
            at = min(at, len(scores) - 1)
            threshold = float(np.sort(scores)[::-1][at])
            found, got = shard.top(asked.places, threshold, at + 1)
            assert np.allclose(np.sort(got)[::-1][: at + 1], np.sort(scores)[::-1][: at + 1])


def test_search_keeps_like_documents_together_and_takes_queries_at_once():
    rng = random.Random(7)
    texts = [" ".join(f"{'ab'[i % 2]}{min(int(rng.expovariate(0.03)), 300)}" for _ in range(rng.randint(5, 60))).encode() for i in range(2600)]
    vectors = [search.term_counts(t) for t in texts]
    batch = search.packed(0, list(range(len(texts))), vectors)
    kinds = np.array(batch.column("ids")[0].as_py()) % 2
    assert np.count_nonzero(np.diff(kinds)) < 50  # in the order of their length alone, kinds change some 1300 times
    df, mean = Counter(x for terms, _ in vectors for x in terms.tolist()), sum(int(tf.sum()) for _, tf in vectors) / len(texts)
    rows = [(q, x, math.log1p((len(texts) - df[x] + 0.5) / (df[x] + 0.5))) for q in range(0, 600, 3) for x in vectors[q][0].tolist()]
    asked = search.Asked.of(pa.table({"query_id": [r[0] for r in rows], "term": np.array([r[1] for r in rows], np.uint64).view(np.int64), "idf": [r[2] for r in rows]}))
    shard = search.Shard({name: batch.column(name)[0] for name in batch.schema.names}, asked, mean)
    whole = list(shard.best(asked.ends, asked.places, asked.thresholds, 10))
    assert [n for n, *_ in whole] == list(range(200))
    for raised in (0.0, 0.7, 1.0):
        limits = np.array([raised * np.sort(score)[-10] for *_, score in whole])
        for n, found, score in shard.best(asked.ends, asked.places, limits, 10):
            best = [int(shard.ids[d]) for _, d in sorted(zip((-np.round(score, 9)).tolist(), found.tolist(), strict=True), key=lambda x: (x[0], shard.ids[x[1]]))][:10]
            assert best == brute_top(list(enumerate(t.decode() for t in texts)), texts[int(asked.ids[n])].decode(), 10) if n % 40 == 0 else len(best) == 10


def test_licences(spark, empty):
    mit = licences.TEMPLATES["MIT-text"]
    rows = [(1, "Intro\nReleased under the MIT license!\nrest"), (2, mit), (3, "about\n\n" + mit.upper() + "\n\nmore\ntext"), (4, None), (5, ""), (6, "the"), (7, "Licensed under the Apache License, Version 2.0"), (8, "All rights reserved." * 3), (1, "Intro\nReleased under the MIT license!\nrest")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").withColumns({c: F.lit("x") for c in ("u", "w", "grams", "best", "unit")})
    got = Counter((r.doc_id, r.unit, r.place, r.licence) for r in licences.scan(docs).collect())
    assert got == Counter([(1, "line", 1, "MIT"), (1, "line", 1, "MIT"), (1, "text", 0, "MIT"), (1, "text", 0, "MIT"), (2, "text", 0, "MIT-text"), (3, "paragraph", 1, "MIT-text"), (3, "text", 0, "MIT-text"), (3, "line", 2, "MIT-text"), (7, "text", 0, "Apache-2.0"), (8, "text", 0, "All-Rights-Reserved")])
    for i, text in rows:
        if text:
            grams = set(licences.bigrams(licences.normalised(text)))
            best = max(((2 * len(grams & set(t)) / max(1, len(grams) + len(t)), n) for n, t in ((n, licences.bigrams(licences.normalised(x))) for n, x in licences.TEMPLATES.items())), default=(0, ""))
            assert (best[0] >= licences.LEAST) == any(k[0] == i and k[1] == "text" for k in got)
    assert licences.scan(empty).count() == 0


def test_chat_linking(spark):
    calls = spark.createDataFrame(
        [
            (1, "a", 0, "reply", '{"turn":1,"text":"x"}', None), (1, "b", 2, "reply", '{"text":5,"more":1}', "a"), (1, "c", 4, "other", "{}", "b"), (1, "d", 5, "reply", "nope", "d"), (1, "e", 6, "reply", None, "missing"),
            (1, "a", 7, "reply", '{"text":"y","turn":2}', None), (2, "a", 0, "reply", '{"turn": 1.5, "text": "ü\\n"}', None), (None, "z", 0, "reply", "{}", None), (2, None, 1, "reply", "{}", None),
        ],
        "conv_id bigint, call_id string, turn bigint, tool string, arguments string, depends_on string",
    )
    results = spark.createDataFrame([(1, "a", 1, "one"), (1, "a", 3, "later"), (1, "q", 9, "lost"), (2, "a", 1, None), (None, "z", 1, "n")], "conv_id bigint, call_id string, turn bigint, content string")
    got = {(r.conv_id, r.call_id, r.call_turn): r for r in chat_format.link_calls(calls, results).collect()}
    assert len(got) == 11
    assert got[1, "a", 0].json == '{"arguments":{"text":"x","turn":1},"call_id":"a","conv_id":1,"result":"one","status":"linked","tool":"reply"}'
    assert (got[1, "a", 0].errors, got[1, "a", 0].n_results, got[1, "a", 7].errors) == ("duplicate_id", 2, "duplicate_id")
    assert (got[1, "b", 2].errors, got[1, "b", 2].depth, got[1, "b", 2].status) == ("type:text,missing:turn,extra:more", 1, "unanswered")
    assert (got[1, "c", 4].errors, got[1, "c", 4].depth) == ("unknown_tool", 2)
    assert (got[1, "d", 5].errors, got[1, "d", 5].depth) == ("not_an_object,cycle", None)
    assert (got[1, "e", 6].errors, got[1, "e", 6].depth) == ("not_an_object", 0)
    assert got[1, "q", None].status == "orphan" and got[2, None, 1].status == "unanswered"
    assert got[2, "a", 0].errors == "" and json.loads(got[2, "a", 0].json)["arguments"] == {"text": "ü\n", "turn": 1.5}


def test_chat_turns(spark):
    rows = [(1, t, "user" if t % 2 == 0 else "assistant", f"t{t}") for t in range(41)] + [(2, 0, "system", "s"), (2, 1, None, None), (None, 0, "user", "x")]
    got = chat_format.format_turns(spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")).collect()
    assert {r.call_turn: r.depth for r in got if r.conv_id == 1} == {t: t // 2 for t in range(0, 41, 2)}
    assert all(r.errors == "" for r in got if r.call_turn is not None) and len(got) == 24
    assert chat_format.format_turns(spark.createDataFrame([], "conv_id bigint, turn bigint, role string, text string")).count() == 0


def test_message_calls(spark):
    rows = [(1, 0, "assistant", '{"tool_calls":[{"id":"a","name":"reply","arguments":"{\\"text\\":\\"x\\",\\"turn\\":0}"}]}'), (1, 1, "tool", '{"tool_call_id":"a","content":"done"}'), (1, 2, "assistant", "plain")]
    got = chat_format.link_calls(*chat_format.message_calls(spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string"))).collect()
    assert [(r.call_id, r.status, r.errors) for r in got] == [("a", "linked", "")]


def test_context_mixing(docs, empty):
    rows = corpus()
    got = context_mixing.score_texts(docs).collect()
    train = [r for r in rows if zlib.crc32(("" if r[0] is None else str(r[0])).encode()) % 5 != 1]
    tokens = lambda r: (r[1] or "").encode().lower().split() + [None]
    c = Counter(t for r in train for t in tokens(r))
    n, v = sum(c.values()), len(c)
    want = Counter((r[0], len(tokens(r)), sum(c[t] > 0 for t in tokens(r)), round(sum(math.log10((c[t] + 0.5) / (n + 0.5 * (v + 1))) for t in tokens(r)), 6)) for r in rows)
    assert Counter((r.doc_id, r.n_tokens, r.n_known, round(r.base_score, 6)) for r in got) == want
    assert {r.train_tokens for r in got} == {n} and all(r.score < 0 for r in got)
    assert len({r.score for r in got if r.doc_id == 5}) == 1
    assert context_mixing.score_texts(empty).count() == 0


def piece(units, gates, a=None):
    order = sorted(range(len(units)), key=lambda i: (gates[i], units[i]))
    n = np.array(a if a is not None else [1] * len(units), np.int64)[order]
    columns = (b"".join(units[i] for i in order), np.array([len(units[i]) for i in order], np.int32), np.array([gates[i] for i in order], np.int32), n, np.zeros(len(n), np.int64), n)
    row = {c: pa.scalar(x if isinstance(x, bytes) else x.tobytes(), pa.binary()) for c, x in zip(("units", "lengths", "gates", "a", "b", "n"), columns)}
    return context_mixing.Piece(row)


def no_shared(rng=None):
    slots = np.full(context_mixing.SLOTS, np.nan, np.float32) if rng is None else rng.normal(size=context_mixing.SLOTS).astype(np.float32)
    return context_mixing.Shared(slots, [(np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0))] * context_mixing.DEEP)


def test_context_mixing_is_a_distribution():
    """The probabilities of all next bytes after a prefix sum to one."""
    rng = np.random.default_rng(0)
    p = piece([b"ab" + bytes([x]) for x in range(256)], [0] * 256, rng.integers(0, 9, 256))
    counts = p.sums(p.weights["a"])
    mixer = context_mixing.Mixer(no_shared(rng), None, np.abs(rng.normal(size=(256 * context_mixing.BUCKETS, 1))) * np.array([[1, 3]]))
    assert mixer.learn(p, counts, np.ones(len(p.row)), 0) > 0
    lp = mixer.log2(p, counts)
    assert abs(sum(2 ** lp[p.place == 2]) - 1) < 1e-6


def test_trie_edges_share_prefixes():
    p = piece([b"a ", b"ab ", b"ab\n", b"b" * 100 + b" "], [0, 0, 0, 1])
    assert len(p.row) == 2 + 2 + 1 + 101
    rows, at = p.paths
    assert sorted(np.bincount(rows).tolist()) == [2, 3, 3, 101]
    assert sorted(p.sums(np.array([1.0, 2.0, 4.0, 8.0])))[-1] == 8 and 7 in p.sums(np.array([1.0, 2.0, 4.0, 8.0]))


def units_frame(spark, n=400):
    rng = random.Random(7)
    seen = {("".join(rng.choice("abc") for _ in range(rng.randint(0, 5))).encode() + b" ", rng.randint(0, 2)) for _ in range(n)} | {(b"x" * 90 + b" ", 0)}
    return [(u, g, rng.randint(0, 5), rng.randint(0, 2), 9) for u, g in sorted(seen)]


def scored_units(spark, rows, chunk):
    cut = context_mixing.pieces_of(spark.createDataFrame(rows, "unit binary, gate int, a bigint, b bigint, n bigint"), chunk).cache()
    shared = context_mixing.shared_of(context_mixing.shared_counts(cut), "a + b")
    return {r.key: r.lp for r in context_mixing.score_units(cut, spark.sparkContext.broadcast((shared, None, None))).collect()}, shared, cut.count()


def test_unit_scores_equal_a_plain_loop_however_pieces_are_cut(spark):
    rows = units_frame(spark)
    got, shared, one = scored_units(spark, rows, 10**6)
    small, _, many = scored_units(spark, rows, 7)
    assert many > 3 * one and got.keys() == small.keys() and all(abs(got[k] - small[k]) < 1e-4 for k in got)
    seen = Counter()
    for unit, gate, a, b, _ in rows:
        for p in range(min(len(unit), context_mixing.DEPTH)):
            for j in range(8):
                for name in (("all", unit[:p]), (gate, unit[:p])):
                    seen[name, j, unit[p] >> (8 - j), (unit[p] >> (7 - j)) & 1] += a + b
    reader = context_mixing.Reader()
    for unit, gate, a, b, _ in rows[::5] + rows[-1:]:
        lp = 0.0
        for p in range(len(unit)):
            back = [unit[p - 1 - k] + 257 - 256 if p > k else 0 for k in range(4)]
            base = [back[0] | (gate + 1) << 9, back[0] | back[1] << 9 | back[2] << 18 | back[3] << 27, back[0] | back[1] << 9 | back[2] << 18]
            for j in range(8):
                bit, partial = (unit[p] >> (7 - j)) & 1, (1 << j) | (unit[p] >> (8 - j))
                x = 0.0
                for k in range(3):
                    context = context_mixing.mixed(np.array([base[k]], np.uint64) + context_mixing.SALTS[k])
                    s = shared.slots[context_mixing.slot_of(context, np.array([partial]))[0]]
                    x += 0.0 if np.isnan(s) else 0.35 * float(s)
                for name in (("all", unit[:p]), (gate, unit[:p])):
                    zero, ones = (seen[name, j, unit[p] >> (8 - j), v] for v in (0, 1))
                    x += 0.35 * math.log((ones + 0.4) / (zero + 0.4)) if zero + ones else 0.0
                q = 1 / (1 + math.exp(-max(-12.0, min(12.0, x))))
                lp += math.log10(q if bit else 1 - q)
        r = reader.read([unit[:-1]]) if unit[-1:] == b"\xff" else None
        data = np.frombuffer(unit, np.uint8)
        key = context_mixing.unit_key(reader.span(reader.sums(data), np.array([0]), np.array([len(unit)])), np.array([gate])).view(np.int64)[0]
        assert r is None and abs(got[int(key)] - lp) < 1e-3 * max(1, abs(lp))


def test_copies_are_told_from_texts_of_their_own(spark):
    rng = random.Random(4)
    text = lambda: " ".join("".join(rng.choice(["ka", "lo", "mi", "nu", "re", "st"]) for _ in range(rng.randint(1, 4))) for _ in range(300))
    rows = [(i, text()) for i in range(60)]
    rows += [(100 + i, rows[i][1]) for i in range(10)] + [(200 + i, rows[20 + i][1].replace(" ka", " ko", 2)) for i in range(10)]
    got = {r.doc_id: r.bits_per_byte for r in context_mixing.score_texts(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    alone = sorted(got[i] for i in range(30, 60))
    learnt = [i for i in range(10) if zlib.crc32(str(i).encode()) % 5 != 1 and zlib.crc32(str(100 + i).encode()) % 5 != 1]
    assert max(got[i] for i in learnt) < alone[0] / 2 and len(learnt) > 3


def test_lookup_finds_all_and_nothing_else():
    rng = np.random.default_rng(1)
    keys = np.sort(rng.integers(0, 1 << 63, 5000, dtype=np.uint64) * np.uint64(2))
    keys[:40] = np.arange(40, dtype=np.uint64) * np.uint64(2)  # many with equal high bits
    lookup = context_mixing.Lookup(np.unique(keys), 10)
    assert (lookup.find(np.unique(keys)) == np.arange(len(np.unique(keys)))).all() and (lookup.find(keys + np.uint64(1)) == -1).all()
    assert context_mixing.Lookup(np.zeros(0, np.uint64)).find(keys[:3]).tolist() == [-1] * 3


def test_followers_without_oneself(spark):
    pairs = spark.createDataFrame([(1, 5, 3), (1, 6, 2), (2, 9, 1), (3, 4, 20)], "a bigint, b bigint, n bigint")
    known = context_mixing.followers(pairs)
    got = {r.key: (r.total, r.g1, r.n1, r.g2, r.n2) for r in known.collect()}
    assert got == {1: (5, 5, 3, 6, 2), 2: (1, 9, 1, None, 0), 3: (20, 4, 20, None, 0)}
    odds = context_mixing.follower_odds(known)
    assert odds[2] == 3.5 / 4 and odds[3] == 0.5 / 3 and odds[16] == 20.5 / 21 and odds[0] == 1.5 / 2


def test_registry_names():
    assert sorted(int(re.match(r"op(\d+)_", n)[1]) for n in registry.QUERIES) == list(range(1, 14))


UNIT = re.compile(rb"[^ \t-\r\xff]*[ \t-\r\xff]")


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.sampled_from(["the", "The", "THE", "der", " ", "  ", "\n", ". ", "!", "\t", "x", "é", "\r\n", " \n", "?\n"]), max_size=25), min_size=1, max_size=4))
def test_reader_finds_every_unit(parts):
    texts = ["".join(x).encode() for x in parts]
    plain = context_mixing.Reader()
    name = lambda w: int(plain.read([w]).token[0])
    reader = context_mixing.Reader({name(b"the"): 1, name(b"der"): 2})
    r = reader.read(texts)
    gates = reader.gates(r)
    units = [UNIT.findall(t + b"\xff") for t in texts]
    assert [bytes(r.data[a : b + 1]) for a, b in zip(r.starts, r.ends)] == [u for x in units for u in x]
    assert r.text.tolist() == [i for i, x in enumerate(units) for _ in x]
    again = [plain.read([t]) for t in texts]
    assert r.unit.tolist() == [h for x in again for h in x.unit.tolist()] and r.token.tolist() == [h for x in again for h in x.token.tolist()]
    want = []
    for x in units:
        kind, stop = 0, 1
        for unit in x:
            want.append(2 * kind + stop)
            kind = {b"the": 1, b"der": 2}.get(unit[:-1].lower(), kind)
            stop = int(unit[-1:] == b"\n" or unit[-2:-1] in (b".", b"!", b"?"))
    assert gates.tolist() == want
    one = [plain.passages(x) for x in again]
    _, ctx, own, _ = plain.passages(plain.read(texts))
    assert ctx.tolist() == [h for x in one for h in x[1].tolist()] and own.tolist() == [h for x in one for h in x[2].tolist()]



def test_short_benchmark_items_match_as_one_run(spark):
    items = spark.createDataFrame([(1, "quartz vole sings"), (2, ""), (3, "one"), (4, None)], "item_id bigint, text string")
    docs = spark.createDataFrame([(1, "here a Quartz vole, sings again"), (2, "vole quartz sings"), (3, "just one"), (4, None), (5, "quartz vole " * 3 + "sang")], "doc_id bigint, text string")
    assert sorted((r.doc_id, r.item_id) for r in decontaminate.contamination(docs, items).collect()) == [(1, 1), (3, 3)]


def test_different_texts_of_one_id_stay(spark):
    docs = spark.createDataFrame([(1, "alpha beta gamma delta epsilon zeta"), (1, "something else that is not like it"), (1, "alpha beta gamma delta epsilon zeta")], "doc_id bigint, text string")
    assert simhash.keep_one(docs).count() == 2 and near_copies.keep_one(docs).count() == 2


def test_text_keys_are_sharded(spark):
    docs = spark.createDataFrame([(f"k{i}", "t") for i in range(50)] + [(None, "t")], "doc_id string, text string")
    got = sharding.assign_shards(docs, 4).collect()
    assert len(got) == 51 and {r.shard for r in got} == {0, 1, 2, 3} and all(r.grown_shard in (r.shard, 4) for r in got)


def test_links_narrow_their_inputs(spark):
    calls = spark.createDataFrame([(1, "a", 0, "reply", '{"text":"x","turn":"y"}', None), (1, "b", 2, "reply", '{"text":"x","turn":2}', "a")], "conv_id bigint, call_id string, turn bigint, tool string, arguments string, depends_on string")
    results = spark.createDataFrame([(1, "a", 1, "ok")], "conv_id bigint, call_id string, turn bigint, content string")
    wide = calls.withColumns({c: F.lit("clash") for c in ("depth", "cyclic", "n_calls", "content", "n_results", "result_turn")})
    got = {r.call_id: (r.status, r.depth, r.errors) for r in chat_format.link_calls(wide, results).collect()}
    assert got == {"a": ("linked", 0, "type:turn"), "b": ("unanswered", 1, "")}
