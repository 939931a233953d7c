"""Queries of linkage, components, relatedness and association."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from callgrove import schema
from callgrove.functions import expr
from callgrove.operators import association, kinship, linalg, linkage, stats
from callgrove.plans.filter_queries import SCORES, some_scores
from callgrove.plans.registry import query
from callgrove.plans.statistic_queries import COUNTS, HWE_SQL, rounded
from callgrove.shared import sized, written

HWE_COUNTS = f", counts AS (SELECT variant_id, {COUNTS} FROM calls GROUP BY 1), {HWE_SQL}"

LD_SQL = """, ix AS (SELECT chrom, variant_id, row_number() OVER (PARTITION BY chrom ORDER BY pos, variant_id) AS i FROM variants),
pr AS (SELECT a.variant_id AS v1, b.variant_id AS v2 FROM ix a JOIN ix b ON a.chrom = b.chrom AND b.i > a.i AND b.i - a.i < 50),
g AS (SELECT * FROM calls WHERE gt IS NOT NULL),
ss AS (SELECT v1, v2, count(*) AS n, CAST(sum(x.gt) AS BIGINT) AS sx, CAST(sum(y.gt) AS BIGINT) AS sy, CAST(sum(x.gt * y.gt) AS BIGINT) AS sxy, CAST(sum(x.gt * x.gt) AS BIGINT) AS sxx, CAST(sum(y.gt * y.gt) AS BIGINT) AS syy
  FROM pr JOIN g x ON x.variant_id = v1 JOIN g y ON y.variant_id = v2 AND y.sample_id = x.sample_id GROUP BY v1, v2),
ld AS (SELECT v1, v2, n, CAST((n * sxy - sx * sy) * (n * sxy - sx * sy) AS DOUBLE) / nullif(CAST((n * sxx - sx * sx) * (n * syy - sy * sy) AS DOUBLE), 0) AS r2 FROM ss)"""


@query(f"{LD_SQL} SELECT v1, v2, n, round(r2, 9) AS r2 FROM ld WHERE r2 > 0.2")
def win4_ld_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Correlated neighbours, the conflicts of the pruning."""
    return rounded(linkage.correlations(schema.kept_calls(spark, sf_dir), schema.variants(spark, sf_dir), 50, 0.2), 9)


@query()
def win4_ld_prune(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linkage.ld_prune(schema.kept_calls(spark, sf_dir), schema.variants(spark, sf_dir))


@query("SELECT variant_id, sample_id, round((gt - 2 * alt_freq) / sqrt(2 * alt_freq * (1 - alt_freq)), 9) AS z FROM calls JOIN freq USING (variant_id) WHERE gt IS NOT NULL AND alt_freq > 0 AND alt_freq < 1")
def lin1_standardise_genotypes(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls = schema.calls(spark, sf_dir)
    return rounded(linalg.standardise(calls, stats.allele_freq(calls)), 9)


@query()
def lin2_pca(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of the samples on ten components."""
    return rounded(linalg.pca(schema.calls(spark, sf_dir), 10, method="auto")[0], 6)


@query()
def lin2_pca_eigenvalues(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(linalg.pca(schema.calls(spark, sf_dir), 10, method="auto")[1], 6)


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return schema.samples(spark, sf_dir).select("sample_id", expr.label_prefix(F.col("iid"), [("PHOM", "CTEPH")], "AGP3K").alias("label"))


@query()
def lin3_pca_group_plot_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores, values, _ = linalg.pca(schema.calls(spark, sf_dir), 4, method="auto")
    return rounded(linalg.pca_view(scores, values, labels(spark, sf_dir)), 6)


@query(f"""{SCORES} SELECT sample_id, pc_name, round(score, 6) AS score, pct, CASE WHEN starts_with(iid, 'PHOM') THEN 'CTEPH' ELSE 'AGP3K' END AS label
FROM (SELECT sample_id, 'pc1' AS pc_name, pc1_avg AS score, CAST(75 AS DOUBLE) AS pct FROM sc UNION ALL SELECT sample_id, 'pc2', pc2_avg, CAST(25 AS DOUBLE) FROM sc) JOIN samples USING (sample_id)""")
def lin3_view_of_given_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The view of two given scores, whose values are as three to one."""
    values = spark.createDataFrame([(1, 3.0), (2, 1.0)], "pc int, eigenvalue double")
    scores = some_scores(spark, sf_dir).select("sample_id", F.col("pc1_avg").alias("pc1"), F.col("pc2_avg").alias("pc2"))
    return rounded(linalg.pca_view(scores, values, labels(spark, sf_dir)), 6)


def weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Given weights: functions of a variant's number."""
    v = schema.variants(spark, sf_dir)
    return v.select("variant_id", *[((F.col("variant_id") * (k + 1) % 17 - 8) / 10.0).alias(f"pc{k + 1}") for k in range(3)])


WEIGHTS = ", wt AS (SELECT variant_id, " + ", ".join(f"(variant_id * {k + 1} % 17 - 8) / 10.0 AS pc{k + 1}" for k in range(3)) + " FROM variants)"


@query(f"{WEIGHTS}, z AS (SELECT variant_id, sample_id, (gt - 2 * alt_freq) / sqrt(2 * alt_freq * (1 - alt_freq)) AS z FROM calls JOIN freq USING (variant_id) WHERE gt IS NOT NULL AND alt_freq > 0 AND alt_freq < 1) SELECT sample_id, count(*) AS n_used, " + ", ".join(f"round(sum(pc{k} * z) / (2 * count(*)), 8) AS pc{k}_avg" for k in (1, 2, 3)) + " FROM z JOIN wt USING (variant_id) GROUP BY sample_id")
def lin4_project_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls = schema.calls(spark, sf_dir)
    return rounded(linalg.project(calls, weights(spark, sf_dir), stats.allele_freq(calls), 3))


@query(f"{WEIGHTS} SELECT DISTINCT variant_id FROM calls JOIN wt USING (variant_id) WHERE gt IS NOT NULL")
def lin5_used_variant_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linalg.score_variants(schema.calls(spark, sf_dir), weights(spark, sf_dir))


def _f(x: str, k: int) -> str:
    return "(" + " * ".join(f"({x} - {i})" for i in range(k)) + ")"


KIN_SQL = f""", sp AS (SELECT a.sample_id AS id1, b.sample_id AS id2, count_if(abs(a.gt - b.gt) = 2) AS n0, count_if(abs(a.gt - b.gt) = 1) AS n1, count_if(a.gt = b.gt) AS n2 FROM calls a JOIN calls b ON a.variant_id = b.variant_id AND a.sample_id < b.sample_id WHERE a.gt IS NOT NULL AND b.gt IS NOT NULL GROUP BY ALL),
xt AS (SELECT CAST(sum(gt) AS DOUBLE) AS x, 2.0 * count(*) - sum(gt) AS y, CAST(2.0 * count(*) AS DOUBLE) AS t FROM calls WHERE gt IS NOT NULL GROUP BY variant_id HAVING 2 * count(*) >= 4),
ex AS (SELECT sum(2 * {_f('x', 2)} * {_f('y', 2)} / nullif({_f('t', 4)}, 0)) AS e00, sum(4 * ({_f('x', 3)} * {_f('y', 1)} + {_f('x', 1)} * {_f('y', 3)}) / nullif({_f('t', 4)}, 0)) AS e10,
  sum(({_f('x', 4)} + {_f('y', 4)} + 4 * {_f('x', 2)} * {_f('y', 2)}) / nullif({_f('t', 4)}, 0)) AS e20, sum(2 * ({_f('x', 2)} * {_f('y', 1)} + {_f('x', 1)} * {_f('y', 2)}) / nullif({_f('t', 3)}, 0)) AS e11,
  sum(({_f('x', 3)} + {_f('y', 3)} + {_f('x', 2)} * {_f('y', 1)} + {_f('x', 1)} * {_f('y', 2)}) / nullif({_f('t', 3)}, 0)) AS e21, count(*) AS m FROM xt),
q0 AS (SELECT sp.*, ex.*, (n0 + n1 + n2) AS n, (n0 + n1 + n2) / m AS s, n0 / nullif(e00 * ((n0 + n1 + n2) / m), 0) AS q0 FROM sp, ex),
q1 AS (SELECT *, (n1 - q0 * e10 * s) / nullif(e11 * s, 0) AS q1 FROM q0), q2 AS (SELECT *, (n2 - q0 * e20 * s - q1 * e21 * s) / nullif(n, 0) AS q2 FROM q1),
tt AS (SELECT *, CASE WHEN q0 > 1 THEN 0 WHEN q1 > 1 THEN 1 WHEN q2 > 1 THEN 2 END AS o, greatest(q0, 0) + greatest(q1, 0) + greatest(q2, 0) AS tot FROM q2),
ph AS (SELECT id1, id2, n0, n1, n2, {', '.join(f"CASE WHEN o IS NOT NULL THEN CASE WHEN o = {i} THEN 1.0 ELSE 0.0 END ELSE greatest(q{i}, 0) / nullif(tot, 0) END AS p{i}" for i in range(3))} FROM tt)"""


@query(f"{KIN_SQL} SELECT id1, id2, n0, n1, n2, round(p0, 7) AS p0, round(p1, 7) AS p1, round(p2, 7) AS p2, round(p1 / 2 + p2, 7) AS pi_hat FROM ph")
def lin6_ibd_pi_hat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(kinship.pi_hat(schema.calls(spark, sf_dir)), 7)


def related(calls: DataFrame, above: float = 0.02) -> DataFrame:
    return expr.round_filter(kinship.pi_hat(calls, above=above).select("id1", "id2", "pi_hat"), "pi_hat", above)


@query()
def lin7_relative_removal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples to remove so that no related pair stays."""
    calls = schema.kept_calls(spark, sf_dir)
    nodes = schema.samples(spark, sf_dir).select("sample_id", (F.col("pheno") == 2).alias("is_case")).join(stats.sample_missing(calls), "sample_id", "left").withColumnRenamed("sample_id", "id")
    return kinship.relative_removal(written(related(calls), "related"), nodes)


def cover_counts(pairs: DataFrame, gone: DataFrame) -> DataFrame:
    """pairs (id1, id2, pair_type) by type, with the pairs that no removed id touches, and removed ids that no pair needs."""
    one, two = (gone.select(F.col("id").alias(f"id{k}"), F.lit(1).alias(f"gone{k}")) for k in (1, 2))
    marked = written(pairs.join(one, "id1", "left").join(two, "id2", "left"), "marked-pairs")
    ends = marked.select(F.col("id1").alias("id"), "gone2", "gone1").unionByName(marked.select(F.col("id2").alias("id"), F.col("gone1").alias("gone2"), F.col("gone2").alias("gone1")))
    unneeded = ends.where("gone1 = 1").groupBy("id").agg(F.count_if(F.col("gone2").isNull()).alias("needs")).agg(F.count_if(F.col("needs") == 0).cast("int").alias("unneeded"))
    counts = marked.groupBy("pair_type").agg(F.count("*").alias("n"), F.count_if(F.col("gone1").isNull() & F.col("gone2").isNull()).cast("int").alias("uncovered"))
    return counts.crossJoin(F.broadcast(unneeded))  # one row


@query(f"""{KIN_SQL} SELECT 'all' AS pair_type, count(*) AS n, 0 AS uncovered, 0 AS unneeded FROM ph WHERE round(p1 / 2 + p2, 3) > 0.02 HAVING count(*) > 0""")
def lin7_cover_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the removal must hold: no related pair is left, and no removed sample could stay."""
    calls = schema.kept_calls(spark, sf_dir)
    nodes = schema.samples(spark, sf_dir).select("sample_id", (F.col("pheno") == 2).alias("is_case")).join(stats.sample_missing(calls), "sample_id", "left").withColumnRenamed("sample_id", "id")
    pairs = written(related(calls), "related")
    return cover_counts(pairs.select("id1", "id2", F.lit("all").alias("pair_type")), kinship.relative_removal(pairs.select("id1", "id2"), nodes))


@query(f"{LD_SQL} SELECT (SELECT count(*) FROM variants WHERE variant_id IN (SELECT variant_id FROM calls)) AS variants, (SELECT count(*) FROM ld WHERE r2 > 0.2) AS linked, 0 AS kept_and_linked, 0 AS dropped_unbeaten")
def win4_prune_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the pruning must hold: no two kept variants are linked, and each dropped one is linked to a kept one that goes before it."""
    calls, variants = schema.kept_calls(spark, sf_dir), schema.variants(spark, sf_dir)
    linked = written(linkage.correlations(calls, variants, 50, 0.2).select("v1", "v2"), "linked")
    nodes = written(linkage.priorities(calls, variants), "nodes")
    kept = written(linkage.prune_ranked(nodes, linked, 50), "kept").withColumn("stays", F.lit(1))
    both = linked.unionByName(linked.select(F.col("v2").alias("v1"), F.col("v1").alias("v2")))
    for k in (1, 2):
        state = nodes.select("variant_id", "prio").join(kept, "variant_id", "left").select(F.col("variant_id").alias(f"v{k}"), F.col("prio").alias(f"p{k}"), F.coalesce("stays", F.lit(0)).alias(f"s{k}"))
        both = both.join(state, f"v{k}")
    beaten = both.where("s1 = 0 AND s2 = 1 AND p2 < p1").select(F.col("v1").alias("variant_id")).distinct()
    dropped = nodes.join(kept, "variant_id", "left_anti").join(beaten, "variant_id", "left_anti")
    return nodes.agg(F.count("*").alias("variants")).crossJoin(linked.agg(F.count("*").alias("linked"))).crossJoin(both.agg(F.count_if((F.col("s1") == 1) & (F.col("s2") == 1)).cast("int").alias("kept_and_linked"))).crossJoin(dropped.agg(F.count("*").cast("int").alias("dropped_unbeaten")))  # one row each


PRODUCTS = "SELECT CAST(a.i AS INT) AS a, CAST(b.i AS INT) AS b, CASE WHEN a.i = b.i THEN 1.0 ELSE 0.0 END AS product FROM range(1, 11) a(i), range(1, 11) b(i) WHERE a.i <= b.i"


def products(scores: DataFrame) -> DataFrame:
    """Products of the score columns: one with itself, zero with others."""
    pairs = [(i, j) for i in range(1, len(scores.columns)) for j in range(i, len(scores.columns))]
    sums = scores.agg(*[F.sum(F.col(f"pc{i}") * F.col(f"pc{j}")).alias(f"s{i}_{j}") for i, j in pairs])
    rows = F.explode(F.array(*[F.struct(F.lit(i).alias("a"), F.lit(j).alias("b"), (F.round(F.col(f"s{i}_{j}"), 6) + 0.0).alias("product")) for i, j in pairs])).alias("r")
    return sums.select(rows).select("r.*")


@query(PRODUCTS)
def lin2_pca_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    return products(linalg.pca(schema.calls(spark, sf_dir), 10, method="auto")[0])


@query(PRODUCTS)
def lin2_pca_approximate_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same of the components by subspace iteration."""
    return products(linalg.pca(schema.calls(spark, sf_dir), 10, method="approximate")[0])


Z_SQL = "z AS (SELECT variant_id, sample_id, (gt - 2 * alt_freq) / sqrt(2 * alt_freq * (1 - alt_freq)) AS z FROM calls JOIN freq USING (variant_id) WHERE gt IS NOT NULL AND alt_freq > 0 AND alt_freq < 1)"


@query(f"{', ' + Z_SQL} SELECT CAST(10 AS INT) AS components, count(*) AS cells, round(sum(z * z), 4) AS squares, CAST(0 AS DOUBLE) AS error_less_rest, CAST(1 AS INT) AS weights_are_unit FROM z HAVING count(*) > 0")
def lin2_pca_reconstruction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The error of the cells rebuilt from scores, values and weights of the subspace iteration: it is what the components leave of all squares.

    error_less_rest is their difference over all squares; weights_are_unit whether each component's weights have squares that add up to one.
    """
    calls = schema.calls(spark, sf_dir)
    scores, values, weights = linalg.pca(calls, 10, method="approximate")
    names = [c for c in scores.columns if c != "sample_id"]
    size = {f"pc{r.pc}": r.eigenvalue * weights.count() for r in values.collect()}
    both = linalg.standardise(calls, stats.allele_freq(calls)).join(sized(scores), "sample_id").join(sized(weights.withColumnsRenamed({n: f"w_{n}" for n in names})), "variant_id")
    rebuilt = sum((F.col(n) * F.col(f"w_{n}") * float(size[n] ** 0.5) for n in names), F.lit(0.0))
    kept = float(sum(size[n] for n in names))
    error = F.sum("z2") - 2 * F.sum("both") + kept  # over all cells, those that are missing are rebuilt too
    unit = weights.agg(F.min(F.lit(1)).alias("one"), *[F.round(F.sum(F.col(n) * F.col(n)), 6).alias(n) for n in names]).select(sum((F.when(F.col(n) != 1, 1).otherwise(0) for n in names), F.lit(0)).alias("off"))
    summed = both.select((F.col("z") * F.col("z")).alias("z2"), (F.col("z") * rebuilt).alias("both"))
    got = summed.agg(F.count("*").alias("cells"), F.sum("z2").alias("squares"), error.alias("error")).where("cells > 0").crossJoin(F.broadcast(unit))  # one row each
    return got.select(F.lit(len(names)).alias("components"), "cells", F.round("squares", 4).alias("squares"), (F.round((F.col("error") - (F.col("squares") - kept)) / F.col("squares"), 6) + 0.0).alias("error_less_rest"), F.when(F.col("off") == 0, 1).otherwise(0).alias("weights_are_unit"))


def scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    samples, scores = schema.samples(spark, sf_dir), some_scores(spark, sf_dir)
    covars = association.covariates(samples, scores).select("sample_id", "sex", "pc1_avg", "pc2_avg").dropna()
    return association.logistic_scan(schema.calls(spark, sf_dir), samples.select("sample_id", "pheno"), covars, ["sex", "pc1_avg", "pc2_avg"])


@query()
def lin8_logistic_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(scan(spark, sf_dir), 6)


def newton_sql(steps: int) -> str:
    """So many steps of Newton's method from zero for a constant and the dosage, each a sum over all calls of a variant."""
    parts = ["""r AS (SELECT variant_id, CAST(gt AS DOUBLE) AS g, CASE WHEN pheno = 2 THEN 1.0 ELSE 0.0 END AS y FROM calls JOIN samples USING (sample_id) WHERE gt IS NOT NULL),
        s0 AS (SELECT variant_id, count(*) AS n, 0.0 AS a, 0.0 AS b FROM r GROUP BY variant_id HAVING min(g) <> max(g) AND min(y) <> max(y))"""]
    for k in range(steps):
        parts.append(f"""h{k} AS (SELECT variant_id, n, a, b, sum(y - p) AS ga, sum((y - p) * g) AS gb, sum(p * (1 - p)) AS haa, sum(p * (1 - p) * g) AS hab, sum(p * (1 - p) * g * g) AS hbb
            FROM (SELECT *, 1 / (1 + exp(-(a + b * g))) AS p FROM r JOIN s{k} USING (variant_id)) GROUP BY variant_id, n, a, b),
        s{k + 1} AS (SELECT variant_id, n, a + (hbb * ga - hab * gb) / (haa * hbb - hab * hab) AS a, b + (haa * gb - hab * ga) / (haa * hbb - hab * hab) AS b FROM h{k})""")
    return f", {', '.join(parts)} SELECT variant_id, n, round(b, 6) + 0.0 AS beta FROM s{steps}"


@query(newton_sql(3))
def lin8_newton_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three steps of the scan without covariates, coefficients as they stand then."""
    people = schema.samples(spark, sf_dir)
    got = association.logistic_scan(schema.calls(spark, sf_dir), people.select("sample_id", "pheno"), people.select("sample_id"), [], steps=3, tolerance=0.0, unsettled=True)
    return rounded(got.where("errcode NOT IN ('NO_CONTRAST', 'CONST_ALLELE')").select("variant_id", "n", "beta"), 6)


@query()
def lin9_association_table_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    view = association.assoc_view(scan(spark, sf_dir), schema.variants(spark, sf_dir), 1e-2, 1000)
    return rounded(view.select("variant_id", "chrom", "pos", "p", "neg_log10_p", "expected", "is_lead"), 6)


@query(f"""{HWE_COUNTS}, a AS (SELECT variant_id, round(p, 12) AS p FROM counts LEFT JOIN hw USING (hom_ref, het, hom_alt)), w AS (SELECT a.*, chrom, pos FROM a JOIN variants USING (variant_id) WHERE p IS NOT NULL)
SELECT variant_id, chrom, pos, round(p, 6) AS p, round(-log10(p), 6) + 0.0 AS neg_log10_p, round(-log10((row_number() OVER (ORDER BY p, variant_id) - 0.5) / count(*) OVER ()), 6) + 0.0 AS expected,
    p < 0.01 AND variant_id = first_value(variant_id) OVER (PARTITION BY chrom, pos // 1000 ORDER BY p, variant_id) AS is_lead FROM w""")
def lin9_view_of_given_p(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The view of the exact Hardy-Weinberg p of all variants."""
    given = stats.hwe_exact(stats.geno_counts(schema.calls(spark, sf_dir))).select("variant_id", F.round("p", 12).alias("p"))
    view = association.assoc_view(given, schema.variants(spark, sf_dir), 1e-2, 1000)
    return rounded(view.select("variant_id", "chrom", "pos", "p", "neg_log10_p", "expected", "is_lead"), 6)


@query(f"{SCORES} SELECT s.sample_id AS sample_id, iid, pheno, sex, pc1_avg FROM samples s LEFT JOIN sc USING (sample_id) WHERE s.sample_id % 2 = 0 AND s.sample_id % 5 <> 0")
def lin10_cohort_assembly(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = schema.samples(spark, sf_dir)
    _, pheno, covars = association.assemble(s, s.where("sample_id % 2 = 0"), s.where("sample_id % 5 = 0"), some_scores(spark, sf_dir))
    return pheno.join(covars, "sample_id").select("sample_id", "iid", "pheno", "sex", "pc1_avg")
