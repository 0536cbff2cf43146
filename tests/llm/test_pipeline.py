"""The corpus pipeline against a brute-force version of its stages."""

import hashlib

import numpy as np
import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from palaver.llm import decontaminate, near_copies
from tests.llm.test_language_id import plain_languages
from tests.llm.test_operators import ITEMS, SCHEMA, brute_components, brute_fingerprint, corpus


def kept_of_groups(rows):
    """Of all rows (doc_id, text, ...) one of each group, by all pairs: fingerprints 3 bits apart or sets of five-word shingles of Jaccard 0.8."""

    def shingles(text):
        w = (text or "").lower().split()
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    prints = [brute_fingerprint(r[1]) for r in rows]
    close = brute_components(set(prints))
    sets = [shingles(r[1]) for r in rows]
    root = list(range(len(rows)))
    find = lambda i: i if root[i] == i else find(root[i])
    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if close[prints[i]] == close[prints[j]] or both and 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
                root[find(i)] = find(j)
    best = {}
    for i, (name, text, *_) in enumerate(rows):
        row = name is None, name or 0, text or ""
        best[find(i)] = min(best.get(find(i), row), row)
    return sorted(best.values())


def test_pipeline(spark, tmp_path):
    rows = [r for r in corpus() if r[0] is not None][:-2]
    words = np.random.default_rng(4).choice(["the", "of", "and", "then", "house", "shining", "when", "thing"], 160).tolist()
    rows += [(900, "Some words before. " + ITEMS[0][1], "en", "leak", 1), (901, " ".join(words), "en", "", 1), (902, " ".join([*words[:-1], "changed"]), "en", "near", 1)]
    rows.append((903, "the and of house " * 40_000, "en", "very long", 1))
    spark.createDataFrame(rows, SCHEMA).repartition(4).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(ITEMS, "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}

    identified = [r for r, (_, lang, score) in zip(rows, plain_languages(rows), strict=True) if lang != "und" and score >= corpus_pipeline.LEAST_LANGUAGE_SCORE]
    clean = {i: t for _, i, t in kept_of_groups(identified) if b"tallest of all the old houses" not in b" ".join(decontaminate.words(t.encode()))}
    assert {901, 903} <= set(clean) and not {900, 902} & set(clean)
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    assert set(got) == set(clean)
    for i, text in clean.items():
        ids = library.encode(text, add_special_tokens=False).ids
        assert got[i].ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()


def test_stages_keep_the_columns(spark, tmp_path):
    docs = spark.createDataFrame(corpus(), SCHEMA)
    spark.createDataFrame(ITEMS, "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, str(tmp_path)).columns == docs.columns
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0


def test_near_copies_are_those_of_brute_force(spark):
    rng = np.random.default_rng(7)
    rows = []
    for base in range(12):
        words = [f"w{x}" for x in rng.integers(0, 5000, 60 + 20 * base)]
        for copy in range(8):  # some edits take a copy below the limit
            new = list(words)
            for at in rng.integers(0, len(new), copy * (1 + base // 4) // 2):
                new[at] = f"e{rng.integers(0, 10**6)}"
            rows.append((len(rows), " ".join(new)))
    passage = " ".join(f"p{x}" for x in range(30))
    rows += [(len(rows) + k, " ".join(f"u{x}" for x in rng.integers(0, 10**6, 30)) + " " + passage) for k in range(40)]
    rows += [(900, ""), (901, " "), (902, None), (903, "one Two"), (904, "one  two"), (905, "one three"), (None, rows[0][1]), (None, "alone " * 3)]

    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5).withColumns({c: F.lit("clash") for c in ("_mark", "_none", "_id", "node", "fp", "root", "lead", "best")})
    got = sorted((r.doc_id is None, r.doc_id or 0, r.text or "") for r in corpus_pipeline.drop_near_copies(spark, docs, "").collect())
    assert got == kept_of_groups(rows)


def test_templated_texts_stay_and_make_few_pairs(spark, monkeypatch):
    """Texts that share many sentences, none of them near copies, all stay, and hardly any pair of them is verified."""
    rng = np.random.default_rng(5)
    sentences = [" ".join(f"w{x}" for x in rng.integers(0, 3000, 12)) for _ in range(200)]
    rows = [(i, ". ".join(sentences[k] for k in rng.choice(200, 12, replace=False))) for i in range(2000)]
    seen = []
    verified = near_copies.minhash.verified
    monkeypatch.setattr(near_copies.minhash, "verified", lambda pairs, sets, percent: seen.append(pairs.count()) or verified(pairs, sets, percent))
    assert near_copies.keep_one(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)).count() == len(rows)
    assert sum(seen) <= len(rows) // 10


def test_near_copies_build_no_tables_in_the_driver(spark):
    """joins of tables that grow with the input are shuffled, whatever the session's threshold; its settings come back, and the map of hashes is collected by words."""
    from palaver.llm import common, near_copies

    seen, before, stored = [], spark.conf.get("spark.sql.autoBroadcastJoinThreshold"), near_copies.stored
    docs = spark.createDataFrame([(i, f"some words of text number {i // 2} and more of them") for i in range(40)], "doc_id bigint, text string")
    near_copies.stored = lambda df, name, **how: (seen.append(spark.conf.get("spark.sql.autoBroadcastJoinThreshold")), stored(df, name, **how))[1]
    try:
        kept = near_copies.keep_one(docs)
    finally:
        near_copies.stored = stored
    assert seen and set(seen) == {"-1"} and spark.conf.get("spark.sql.autoBroadcastJoinThreshold") == before
    assert "BroadcastHashJoin" not in kept._jdf.queryExecution().executedPlan().toString() and kept.count() <= 20
    hashes = [0, 1, 63, 64, -1, 2**40 + 5, (1 << 24) - 1, 2**63 - 1]
    bits = common.bitmap(spark.createDataFrame([(h,) for h in hashes], "key bigint"))
    import numpy as np

    assert common.in_bitmap(bits, np.array(hashes)).all() and not common.in_bitmap(bits, np.array([2, 62, 65, 128, 2**40 + 6])).any() and bits.nbytes == common.BITMAP // 8
