"""Operator 4: quality rules as a short-circuit cascade, in built-in functions only.

Base figures of each text (words, symbols, repeated lines, words in repeated 3-word windows) come from arrays inside the
row, so no text is shuffled. The rules run as one CASE: a document is rejected by the first rule that objects, and later
rules aren't evaluated for it. On a sample of bounded size each rule's cost (time for all sample rows) and selectivity
(share it rejects) are measured; rules are ordered by rejections per cost. The order changes cost, never the verdict.

Defined results: a null or empty text has no words, so that all figures are 0 and the base rule fails; repeated rows get
equal results; other columns of the input are dropped but for doc_id. An empty table gives no rows (the order is then that of the rules' names).
A very long text is a row of arrays of its words and windows. Rules of equal worth are ordered by cost, then by name.
"""

from __future__ import annotations

import time

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from callgrove.llm.common import written
from callgrove.llm.native import let, space_words

#: Rows of the sample that cost and selectivity are measured on, bytes of a text in it, and timed runs of a rule over it.
SAMPLE_ROWS, SAMPLE_BYTES, TIMED = 1000, 1 << 16, 2


def repeated_words(words: Column) -> Column:
    """Words in 3-word windows that occur twice or more; windows are compared by 64-bit hashes, sorted with their places."""
    hashes = F.transform(F.sequence(F.lit(0), F.size(words) - 3), lambda i: F.xxhash64(words[i], words[i + 1], words[i + 2]))

    def places(sorted_: Column) -> Column:
        last = F.size(sorted_) - 1
        same = lambda k: F.when(k > 0, sorted_[k]["h"] == sorted_[F.greatest(k - 1, F.lit(0))]["h"]).otherwise(False) | F.when(k < last, sorted_[k]["h"] == sorted_[F.least(k + 1, last)]["h"]).otherwise(False)
        found = F.transform(F.filter(sorted_, lambda _, k: same(k)), lambda x: x["i"])
        return F.size(F.array_distinct(F.flatten(F.transform(found, lambda i: F.array(i, i + 1, i + 2)))))

    def count(h: Column) -> Column:
        paired = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(h)) == F.size(h), 0).otherwise(let(paired, places))

    return F.when(F.size(words) < 3, 0).otherwise(let(hashes, count))


def base_figures(docs: DataFrame) -> DataFrame:
    """doc_id, text, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    text = F.coalesce("text", F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    by_words = let(space_words(F.col("text")), lambda w: F.struct(F.size(w).alias("n_words"), F.length(F.array_join(w, "")).alias("word_chars"), repeated_words(w).alias("n_repeat_words")))
    by_lines = let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x)))
    got = docs.select("doc_id", "text", by_words.alias("w"), F.regexp_count(text, F.lit(r"[#*$%&|<>]")).alias("n_symbols"), by_lines.alias("n_dup_lines"))
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    where = {"n_words": "w.n_words", "word_chars": "w.word_chars", "n_repeat_words": "w.n_repeat_words"}
    return got.select("doc_id", "text", *[F.col(where.get(n, n)).cast("long").alias(n) for n in names])


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 50)


def default_rules() -> dict[str, Column]:
    """Rules over base_figures(); true where a rule objects."""
    text = F.coalesce("text", F.lit(""))
    return {
        "symbols": F.col("n_symbols") * 100 > F.col("word_chars") * 10,
        "repeated_lines": F.col("n_dup_lines") * 2 > F.size(F.split(text, "\n")),
        "word_length": ~F.col("word_chars").between(F.col("n_words") * 2, F.col("n_words") * 20),
        "few_letters": F.regexp_count(text, F.lit(r"\p{L}")) * 2 < F.col("word_chars"),
        "few_words": let(space_words(F.col("text")), lambda w: F.size(F.array_distinct(w)) * 20 < F.size(w)),
    }


def first_rows(docs: DataFrame, rows: int, most_bytes: int = SAMPLE_BYTES) -> DataFrame:
    """The first rows that a scan gives, without long texts: the scan ends there, and the driver holds rows * most_bytes at most."""
    few = docs.where(F.coalesce(F.octet_length("text"), F.lit(0)) <= most_bytes).head(rows)
    return docs.sparkSession.createDataFrame([tuple(r) for r in few], docs.schema)


def measured_order(figures: DataFrame, rules: dict[str, Column]) -> list[tuple[str, float, float]]:
    """(rule, seconds for a sample row, share rejected) in the order of the cascade: most rejections per second first.

    figures are those of a sample, written as one partition. A rule goes over it once to be compiled and TIMED times for the clock; the
    least time counts, less that of a rule that rejects nothing at no cost. Differences below a hundredth of the empty job's time are noise and count as that much.
    """
    sample = written(figures.coalesce(1), "quality-sample")

    def run(objects: Column) -> tuple[float, int, int]:
        job = sample.agg(F.coalesce(F.sum(F.coalesce(objects, F.lit(False)).cast("int")), F.lit(0)), F.count("*"))
        times = []
        for _ in range(TIMED + 1):
            began = time.perf_counter()
            hits, n = job.first()
            times.append(time.perf_counter() - began)
        return min(times[1:]), hits, max(1, n)

    empty, _, _ = run(F.col("n_words") < 0)
    found = []
    for name, objects in rules.items():
        seconds, hits, n = run(objects)
        found.append((name, max(seconds - empty, empty / 100) / n, hits / n))
    return sorted(found, key=lambda x: (-x[2] / x[1], x[1], x[0]))


def cascade(figures: DataFrame, rules: dict[str, Column], order: list[str]) -> DataFrame:
    """figures with kept: false where base_failed or a rule of the cascade objects."""
    verdict = F.when(F.col("base_failed"), False)
    for name in order:
        verdict = verdict.when(F.coalesce(rules[name], F.lit(False)), False)
    return figures.withColumn("base_failed", base_failed()).withColumn("kept", verdict.otherwise(True))


def quality(docs: DataFrame, rules: dict[str, Column] | None = None, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """doc_id, the base figures, base_failed and kept for each document."""
    rules = rules or default_rules()
    plain = docs.select("doc_id", "text")
    order = [name for name, _, _ in measured_order(base_figures(first_rows(plain, sample_rows)), rules)]
    return cascade(base_figures(plain), rules, order).drop("text")
