"""Operator 10: secret scans with multipart credential linking, in built-in functions only.

Base spans (assign, access, hex) come from one regular expression each. Weak parts (unlabelled random-looking secrets,
endpoints, user names) count only together: parts become rows keyed by document and by scope bin, an interval join
(equal bins, then distance of at most `reach` code points) links them, and
- a weak secret is reported next to an access identifier or a user name with an endpoint,
- an endpoint or a user name is reported next to both an access identifier (or a user name, or an endpoint) and a secret.
Only documents that hold an anchor are taken apart. Bins bound each key by the reach, so a document of many parts spreads.

Defined results: a null or empty text has no spans; positions are code points, end exclusive; repeated rows (same doc_id
and text) get equal results; rows that share a doc_id with different texts are scanned apart; a null doc_id stays null;
other columns of the input are dropped by scan() and kept by redact(), whatever their names; n_chars is made again. An empty table gives an
empty one. Very long texts take time in proportion to their length and matches (tested up to 100,000 matches). Matches of one kind never tie; spans
of equal start are ordered by kind.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from callgrove.llm.common import free_name, sized, written
from callgrove.llm.native import let, sums_before

#: Code points between the starts of parts that belong together.
REACH = 400
#: Code points of a block of a text that is cut.
CUT = 1024
ASSIGN = r"(?i)(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
#: Of these two the shortest match that counts is in the pattern: shorter runs hold no longer one.
ACCESS, HEX = r"AKIA[A-Z0-9]{16,}", r"[0-9a-f]{24,}"
BASE = ["assign", "access", "hex"]
WEAK = {
    "secret": r"(?<![A-Za-z0-9+/=_-])(?=[A-Za-z0-9+/]*[0-9])(?=[A-Za-z0-9+/]*[a-z])(?=[A-Za-z0-9+/]*[A-Z])[A-Za-z0-9+/]{32,64}={0,2}(?![A-Za-z0-9+/=_-])",
    "endpoint": r"(?i)\bhttps?://[a-z0-9._~:/?#@!$&()*+,;=%-]+",
    "user": r"(?i)\b(?:user|username|login|client_?id)[\"']?\x20*[:=]\x20*[\"']?[a-z0-9@._+-]{2,}",
}
KINDS = [*BASE, *WEAK]


def spans_of(text: Column, kind: str, pattern: str) -> Column:
    """Spans (start, kind, end) of the matches of a pattern: lengths between and of the matches add up to the places.

    Every array is bound once, so the work is in proportion to the text and its matches.
    """

    def placed(found: Column, gaps: Column) -> Column:
        lengths = F.transform(found, lambda m, k: F.length(gaps[k]) + F.length(m))
        span = lambda at: lambda m, k: F.struct((at[k] + F.length(gaps[k])).alias("start"), F.lit(KINDS.index(kind)).alias("kind"), (at[k] + F.length(gaps[k]) + F.length(m)).alias("end"), m.alias("m"))
        return let(sums_before(lengths), lambda at: F.transform(found, span(at)))

    none = F.array().cast("array<struct<start:bigint,kind:int,end:bigint,m:string>>")
    spans = let(F.regexp_extract_all(text, F.lit(pattern), 0), lambda found: F.when(F.size(found) == 0, none).otherwise(let(F.split(text, pattern), lambda gaps: placed(found, gaps))))
    if kind == "assign":
        spans = F.filter(spans, lambda s: F.length(F.regexp_extract(s["m"], pattern, 2)) >= 6)
    return F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end")))


def joined(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(F.sort_array(spans), lambda s: F.concat_ws(":", names[s["kind"]], s["start"].cast("string"), s["end"].cast("string"))), ",")


def base_spans(docs: DataFrame) -> DataFrame:
    """doc_id, text_key and the base spans of each row."""
    text = F.coalesce("text", F.lit(""))
    return docs.select("doc_id", F.md5(text.cast("binary")).alias("text_key"), spans_of(text, "assign", ASSIGN).alias("assign"), spans_of(text, "access", ACCESS).alias("access"), spans_of(text, "hex", HEX).alias("hex"))


def linked_spans(docs: DataFrame, reach: int = REACH) -> DataFrame:
    """doc_id, text_key and the weak spans that complementary parts support."""
    text = F.col("text")
    anchored = docs.where(text.contains("AKIA") | (text.contains("://") & text.rlike(WEAK["user"])))
    keyed = anchored.select("doc_id", F.md5(text.cast("binary")).alias("text_key"), "text").dropDuplicates(["doc_id", "text_key"])
    patterns = {"assign": ASSIGN, "access": ACCESS, "hex": HEX, **WEAK}
    found = keyed.select("doc_id", "text_key", F.concat(*[spans_of(text, k, p) for k, p in patterns.items()]).alias("spans"))
    parts = found.select("doc_id", "text_key", F.explode("spans").alias("s")).select("doc_id", "text_key", "s.*", F.floor(F.col("s.start") / reach).alias("bin"))
    kind = {k: KINDS.index(k) for k in KINDS}
    weak = parts.where(F.col("kind").isin([kind[k] for k in WEAK])).withColumn("key", F.explode(F.array(F.col("bin") - 1, F.col("bin"), F.col("bin") + 1)))
    other = parts.select("doc_id", "text_key", F.col("bin").alias("key"), F.col("start").alias("at"), F.col("kind").alias("by"), F.col("end").alias("till"))
    # a base span is no partner of a weak span that lies on it: that is one part under two names
    apart = (F.col("till") <= F.col("start")) | (F.col("at") >= F.col("end"))
    pairs = weak.alias("w").join(other.alias("o"), F.col("w.doc_id").eqNullSafe(F.col("o.doc_id")) & (F.col("w.text_key") == F.col("o.text_key")) & (F.col("w.key") == F.col("o.key")) & (F.abs(F.col("at") - F.col("start")) <= reach) & apart)
    near = lambda *names: F.max(F.col("by").isin([kind[n] for n in names]).cast("int")) == 1
    tallied = pairs.groupBy("w.doc_id", "w.text_key", "start", "kind", "end").agg(near("access").alias("access"), near("assign", "hex", "secret").alias("secret"), near("endpoint").alias("endpoint"), near("user").alias("user"))
    kept = tallied.where(
        ((F.col("kind") == kind["secret"]) & (F.col("access") | (F.col("user") & F.col("endpoint"))))
        | ((F.col("kind") == kind["endpoint"]) & F.col("secret") & (F.col("access") | F.col("user")))
        | ((F.col("kind") == kind["user"]) & F.col("secret") & F.col("endpoint"))
    )
    return kept.groupBy("doc_id", "text_key").agg(F.collect_list(F.struct("start", "kind", "end")).alias("weak"))


def all_spans(docs: DataFrame, reach: int = REACH) -> DataFrame:
    """doc_id, text_key, the base spans by kind and all spans of each row."""
    base, weak = base_spans(docs), linked_spans(docs, reach)
    weak = weak.select(F.col("doc_id").alias("weak_id"), F.col("text_key").alias("weak_key"), "weak")
    both = base.join(weak, F.col("doc_id").eqNullSafe(F.col("weak_id")) & (F.col("text_key") == F.col("weak_key")), "left").drop("weak_id", "weak_key")
    strong = F.concat("assign", "access", "hex")
    return both.withColumn("base", F.sort_array(strong)).withColumn("spans", F.sort_array(F.when(F.col("weak").isNull(), strong).otherwise(F.concat(strong, "weak")))).drop("weak")


def scan(docs: DataFrame, reach: int = REACH) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256 and spans of each document."""
    got = all_spans(docs.select("doc_id", "text"), reach)
    counts = [F.size(k).cast("long").alias(f"n_{k}") for k in BASE]
    return got.select("doc_id", *counts, F.sha2(joined(F.col("base")), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


def runs_of(found: DataFrame) -> DataFrame:
    """doc_id, text_key and the runs (start, end) of overlapping spans in order, from rows of (doc_id, text_key, spans)."""
    spans = found.select("doc_id", "text_key", F.explode("spans").alias("s")).select("doc_id", "text_key", "s.start", "s.end").distinct()
    own = Window.partitionBy("doc_id", "text_key").orderBy("start", "end")
    reached = F.max("end").over(own.rowsBetween(Window.unboundedPreceding, -1))
    numbered = spans.withColumn("begins", F.coalesce(F.col("start") >= reached, F.lit(True)).cast("int")).withColumn("run", F.sum("begins").over(own))
    runs = numbered.groupBy("doc_id", "text_key", "run").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    return runs.groupBy("doc_id", "text_key").agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("runs"))  # those of one text


def redact(docs: DataFrame, mark: str = "[SECRET]", reach: int = REACH) -> DataFrame:
    """docs with every span, or run of overlapping spans, of their texts replaced by a mark; n_chars follows the text."""
    found = all_spans(docs.select("doc_id", "text"), reach).where(F.size("spans") > 0)
    span_id, span_key, runs, key = (free_name(docs, n) for n in ("span_id", "span_key", "span_runs", "own_key"))
    spans = sized(written(runs_of(found).toDF(span_id, span_key, runs), "spans"), 500_000)
    keyed = docs.withColumn(key, F.md5(F.coalesce("text", F.lit("")).cast("binary")))
    both = keyed.join(spans, F.col("doc_id").eqNullSafe(F.col(span_id)) & (F.col(key) == F.col(span_key)), "left")

    def cut(s: Column) -> Column:
        """The text between the runs and the marks; it is cut into blocks first, since a place in a long text is found by counting."""
        text, last = F.col("text"), lambda k: F.when(k == 0, F.lit(0).cast("long")).otherwise(s[F.greatest(k - 1, F.lit(0))]["end"])
        blocks = F.transform(F.sequence(F.lit(0), F.floor(F.length(text) / CUT).cast("int")), lambda b: text.substr(b * CUT + 1, F.lit(CUT)))

        def part(blocks: Column, start: Column, end: Column) -> Column:
            first = F.floor(start / CUT)
            own = F.array_join(F.slice(blocks, (first + 1).cast("int"), (F.floor(end / CUT) - first + 1).cast("int")), "")
            return own.substr((start % CUT + 1).cast("int"), (end - start).cast("int"))

        kept = lambda blocks: F.concat(F.array_join(F.transform(s, lambda x, k: F.concat(part(blocks, last(k), x["start"]), F.lit(mark))), ""), part(blocks, s[F.size(s) - 1]["end"], F.length(text).cast("long")))
        return let(blocks, kept)

    changed = both.withColumn("text", F.when(F.col(runs).isNull(), F.col("text")).otherwise(let(F.col(runs), cut)))
    columns = [F.length("text").cast(docs.schema[c].dataType).alias(c) if c == "n_chars" else F.col(f"`{c}`") for c in docs.columns]
    return changed.select(*columns)
