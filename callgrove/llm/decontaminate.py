"""Operator 8: benchmark decontamination as a prefix-filtered set join, in built-in functions only.

Every window of an item (n consecutive words; a shorter item is one window) must occur word for word, so a window and a
document agree on all tokens and the necessary prefix is one token: the window's rarest word by its count in the whole
corpus. Document words are joined with these prefix tokens alone; the token's place in the window fixes where the window
would begin, the length bound keeps it inside the document, and the words there are compared with the window.
Windows are broadcast in blocks of a fixed number of rows, so a large benchmark means more passes and not more memory.

Defined results: null and empty texts have no words and no hits; repeated documents get equal results; rows that share a
doc_id with different texts are judged apart; items that repeat count once each by item_id; an empty benchmark hits nothing; other
columns are dropped by contamination() and kept by clean(), whatever their names.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from callgrove.llm.common import free_name, sized, written
from callgrove.llm.native import ascii_lower, let

#: Characters that part words, and windows in one broadcast (some 40 MB at 200 bytes a window).
GAP, BLOCK_WINDOWS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", 200_000


def words_of(text: Column) -> Column:
    """Lower-case words of a text; none for null."""
    return let(F.split(ascii_lower(F.coalesce(text, F.lit(""))), GAP), lambda w: F.slice(w, F.when(w[0] == "", 2).otherwise(1), F.greatest(F.size(w) - F.when(w[0] == "", 1).otherwise(0) - F.when((w[F.size(w) - 1] == "") & (F.size(w) > 1), 1).otherwise(0), F.lit(0))))


def windows_of(benchmark: DataFrame, size: int) -> DataFrame:
    """item_id and win: each window of an item as an array of words."""
    items = benchmark.select("item_id", words_of(F.col("text")).alias("words")).where(F.size("words") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("words") - size + 1, F.lit(1)))
    return items.select("item_id", "words", F.explode(starts).alias("at")).select("item_id", F.slice("words", F.col("at"), size).alias("win")).distinct()


def prefixes(docs: DataFrame, windows: DataFrame) -> DataFrame:
    """item_id, win, token and offset: the rarest word of each window by its count over all documents."""
    own = windows.select(F.explode("win").alias("token")).distinct()
    seen = docs.select(F.explode(words_of(F.col("text"))).alias("token"))
    counts = seen.join(F.broadcast(own) if own.count() <= BLOCK_WINDOWS else own, "token", "left_semi").groupBy("token").agg(F.count("*").alias("n"))
    placed = windows.select("item_id", "win", F.posexplode("win").alias("offset", "token")).join(counts, "token", "left")
    rarest = F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "token", "offset"))
    return placed.groupBy("item_id", "win").agg(rarest.alias("r")).select("item_id", "win", "r.token", "r.offset", F.col("r.n").alias("n"))


def occurrences(docs: DataFrame, benchmark: DataFrame, size: int = 10) -> DataFrame:
    """doc_id, text_key, item_id, begin and end (words, end exclusive) of each occurrence of a window."""
    found = written(prefixes(docs, windows_of(benchmark, size)).where("n > 0"), "windows")
    blocks = -(-found.count() // BLOCK_WINDOWS)
    words = docs.select("doc_id", F.md5(F.coalesce("text", F.lit("")).cast("binary")).alias("text_key"), words_of(F.col("text")).alias("words"))
    tokens = words.select("doc_id", "text_key", "words", F.posexplode("words").alias("place", "token"))

    def matched(block: DataFrame) -> DataFrame:
        begin, length = F.col("place") - F.col("offset"), F.size("win")
        same = (begin >= 0) & (begin + length <= F.size("words")) & (F.slice("words", F.greatest(begin, F.lit(0)) + 1, length) == F.col("win"))
        return tokens.join(F.broadcast(block.drop("n")), "token").where(same).select("doc_id", "text_key", "item_id", begin.alias("begin"), (begin + length).alias("end"))

    parts = [matched(found.where(F.pmod(F.xxhash64("token", "win"), F.lit(blocks)) == b) if blocks > 1 else found) for b in range(max(1, blocks))]
    return reduce(DataFrame.unionByName, parts)


def contamination(docs: DataFrame, benchmark: DataFrame, size: int = 10) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256 and contaminated of each document."""
    docs = docs.select("doc_id", "text")
    before = Window.partitionBy("doc_id", "text_key").orderBy("begin", "end").rowsBetween(Window.unboundedPreceding, -1)
    spans = occurrences(docs, benchmark, size)
    covered = spans.withColumn("own", F.greatest(F.col("end") - F.greatest(F.col("begin"), F.coalesce(F.max("end").over(before), F.lit(0))), F.lit(0)))
    hits = covered.groupBy(F.col("doc_id").alias("hit_id"), F.col("text_key").alias("hit_key")).agg(F.sum("own").alias("n_hit"), F.sort_array(F.collect_set(F.col("item_id").cast("string"))).alias("items"))
    text = F.coalesce("text", F.lit(""))
    whole = docs.select("doc_id", F.md5(text.cast("binary")).alias("text_key"), F.regexp_count(text, F.lit(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")).cast("long").alias("n_words"))
    both = whole.join(hits, F.col("doc_id").eqNullSafe(F.col("hit_id")) & (F.col("text_key") == F.col("hit_key")), "left")
    n_hit = F.coalesce("n_hit", F.lit(0)).cast("long")
    return both.select("doc_id", "n_words", n_hit.alias("n_hit"), F.coalesce(F.size("items"), F.lit(0)).cast("long").alias("n_items"), F.sha2(F.coalesce(F.array_join("items", ","), F.lit("")), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))


def clean(docs: DataFrame, benchmark: DataFrame, size: int = 10) -> DataFrame:
    """docs that hold no window of the benchmark, with all their columns."""
    hit_id, hit_key = free_name(docs, "hit_id"), free_name(docs, "hit_key")
    found = occurrences(docs.select("doc_id", "text"), benchmark, size).select(F.col("doc_id").alias(hit_id), F.col("text_key").alias(hit_key)).distinct()
    hit = written(found, "hits")
    key = F.md5(F.coalesce("text", F.lit("")).cast("binary"))
    return docs.join(sized(hit), F.col("doc_id").eqNullSafe(F.col(hit_id)) & (key == F.col(hit_key)), "left_anti")
