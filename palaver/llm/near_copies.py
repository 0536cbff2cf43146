"""Near copies of both kinds: texts with SimHash fingerprints close to each other (operator 9), and texts with similar sets of word shingles (operator 11).

Three of 64 bits miss most pairs of a similarity of 0.8, so the fingerprints alone would leave about half of the near copies. Texts are linked if their fingerprints
are within operator 9's distance, or if their sets of ``WORDS``-word shingles have a Jaccard coefficient of ``PERCENT`` hundredths or more; components are those of all links.

Both kinds are links between different texts, told apart by a hash: copies, however many, are one node, and only texts that lead no group have a link.

Defined cases: texts without words (null, empty, white space) have fingerprint zero and are alike; a text of fewer words than a shingle is one shingle; repeated rows and rows
with a null id are members like others, rows without an id come after all others; a very long text is read whole; columns of any name are kept; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palaver.llm import minhash, simhash
from palaver.llm.common import fresh, join_split, no_broadcasts, row_key, small_batches, stored

WORDS, PERCENT = 5, 80


def fingerprint_leads(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(a, b): every text with the one that leads the component of its fingerprint, unless it is that one itself."""
    _, mark = row_key(id_col, text_col)
    prints = stored(docs.select(mark.alias("mark"), simhash.fingerprint_column(F.col(text_col), simhash.WORDS).alias("fp")).distinct(), "prints")
    roots = simhash.components(simhash.fingerprint_links(prints.select("fp").distinct()))
    least = prints.groupBy("fp").agg(F.min("mark").alias("mark")).join(roots.withColumnRenamed("node", "fp"), "fp", "left")
    rooted = stored(least.select("fp", "mark", F.coalesce("root", "fp").alias("root")), "rooted")
    leads = stored(rooted.groupBy("root").agg(F.min("mark").alias("lead")), "leads")
    led = stored(join_split(rooted.select("fp", "root"), leads, "root").select("fp", "lead"), "led")
    return join_split(prints, led, "fp").filter("mark <> lead").select(F.col("mark").alias("a"), F.col("lead").alias("b"))


def representatives(docs: DataFrame, id_col: str, text_col: str, words: int, percent: int) -> DataFrame:
    """(none, id, mark) of the row with the smallest id of every component of near copies."""
    with small_batches(docs.sparkSession), no_broadcasts(docs.sparkSession):
        close = fingerprint_leads(docs, id_col, text_col)
        rows = minhash.grouped(docs, id_col, text_col, words, percent)
        similar = rows.filter("best.mark <> mark").select(F.col("mark").alias("a"), F.col("best.mark").alias("b")).distinct()
        roots = simhash.components(close.unionByName(similar))
        texts = rows.groupBy("mark").agg(F.min(F.struct("none", "id", "mark")).alias("best")).join(roots.withColumnRenamed("node", "mark"), "mark", "left")
        return stored(texts.groupBy(F.coalesce("root", "mark").alias("root")).agg(F.min("best").alias("best")).select("best.*"), "kept")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """The row with the smallest id of every component of near copies, whole and with all columns; of rows with the same id and text one stays."""
    best = representatives(docs, id_col, text_col, words, percent)
    none, mark = row_key(id_col, text_col)
    keys = [fresh(docs, k) for k in ("_none", "_mark", "_id")]
    kept = best.select(F.col("none").alias(keys[0]), F.col("mark").alias(keys[1]), F.coalesce(F.col("id").cast("string"), F.lit("")).alias(keys[2]))
    # One shuffle of the texts serves the join and the removal of repeated rows.
    marked = docs.select("*", none.alias(keys[0]), mark.alias(keys[1]), F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias(keys[2]))
    return marked.join(kept.hint("merge"), keys, "left_semi").dropDuplicates(keys).select(docs.columns)
