"""Hand-made rows for the rules on NULLs, bounds and ties."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from callgrove import schema, shared
from callgrove.functions import expr, reference
from callgrove.operators import association, concordance, filters, kinship, linkage, selection, stats


def calls(spark, rows):
    return spark.createDataFrame([(*r, *[None] * (7 - len(r))) for r in rows], schema.CALLS)


def test_masking(spark):
    rows = [(1, 1, 1, None, None, 0.5), (1, 2, 1, 30, 30, 0.25), (1, 3, 1, 30, 30, 0.75), (1, 4, 2, 30, 30, 0.1), (1, 5, 1, 30, 30, 0.24), (1, 6, 0, 7, 30, 0.0), (1, 7, 0, 8, 20, 0.0), (1, 8, 0, 8, 19, 0.0)]
    got = {r.sample_id: r.gt for r in filters.mask_calls(calls(spark, rows), 8, 20, 0.25, 0.75).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 2, 5: None, 6: None, 7: 0, 8: None}


@pytest.mark.parametrize(("triple", "p"), [((57, 14, 50), 5.562047e-19), ((10, 20, 10), 1.0), ((0, 0, 5), 1.0), ((1, 0, 0), 1.0)])
def test_exact_hwe(spark, triple, p):
    both = spark.createDataFrame([triple, triple[::-1]], "hom_ref long, het long, hom_alt long")
    for r in stats.hwe_exact(both).collect():
        assert math.isclose(r.p, p, rel_tol=1e-5)


def test_hwe_modes(spark):
    df = spark.createDataFrame([(1, 0.5, 0.5), (2, None, 0.5), (3, 0.5, None), (4, 1e-11, 0.5)], "variant_id long, p_case double, p_control double")
    assert [r.variant_id for r in filters.pass_hwe(df, "case_control").collect()] == [1]
    assert [r.variant_id for r in filters.pass_hwe(df, "only_control").collect()] == [1, 2, 4]
    with pytest.raises(ValueError, match="mode"):
        filters.pass_hwe(df, "other")


def test_bounds(spark):
    df = spark.createDataFrame([(1, 0.1, 0.04), (2, 0.1, 0.0399), (3, 0.0, 0.0)], "variant_id long, maf double, f_miss double")
    assert [r.variant_id for r in filters.polymorphic(df).collect()] == [2]
    values = spark.createDataFrame([(1.0,), (2.0,), (4.0,), (9.0,)], "v double")
    assert values.select(F.percentile("v", [0.025, 0.5, 0.975]).alias("q")).first().q == pytest.approx([1.075, 3, 8.625])
    pairs = spark.createDataFrame([(1, 0.2004), (2, 0.2006)], "id long, pi_hat double")
    assert [r.id for r in expr.round_filter(pairs, "pi_hat", 0.2).collect()] == [2]


def test_quantiles_equal_the_built_in_ones(spark):
    r = random.Random(4)
    rows = [(r.choice(["a", "b", None]), r.choice([None, 1.0, r.gauss(0, 3)])) for _ in range(400)] + [("one", 5.0), ("same", 2.0), ("same", 2.0), ("none", None), ("far", -1e300), ("far", 1e300), ("far", 0.5)]
    df, probs = spark.createDataFrame(rows, "g string, v double"), [0.0, 0.025, 0.25, 0.5, 0.75, 1.0]
    want = {x.g: x.q for x in df.where("v IS NOT NULL").groupBy("g").agg(F.percentile("v", probs).alias("q")).collect()}
    got = {x.g: x.q for x in stats.quantiles(df, "v", probs, ["g"]).collect()}
    assert got.keys() == want.keys() and all(got[g] == pytest.approx(want[g], rel=1e-12) for g in want)
    assert stats.quantiles(df, "v", probs).first().q == pytest.approx(df.agg(F.percentile("v", probs).alias("q")).first().q, rel=1e-12)
    assert stats.quantiles(df.limit(0), "v", probs).count() == 0 and filters.central(df.limit(0), "v").count() == 0
    boxes = {x.g: x for x in stats.box_stats(df, "v", ["g"]).collect()}
    assert set(boxes) == {"a", "b", "one", "same", "none", "far"} and boxes["none"].median is None and boxes["one"].whisker_low == 5


def test_ranks_of_stretches_equal_one_window(spark):
    r = random.Random(6)
    rows = [(k, r.choice(["chr1", "chr2", None]), r.choice([None, r.randrange(200)])) for k in range(300)]
    df = spark.createDataFrame(rows, "variant_id long, chrom string, pos long")
    whole = df.withColumn("idx", F.row_number().over(Window.partitionBy("chrom").orderBy("pos", "variant_id")))
    got = linkage.indexed(df, 10)
    assert got.columns == whole.columns and sorted(map(str, got.collect())) == sorted(map(str, whole.collect()))


def test_projections(spark):
    df = spark.createDataFrame([(x,) for x in ("0/0", "0|1", "1/0", "1|1", "./1", "./.", "0/2", "1", None)], "g string")
    assert [r[0] for r in df.select(expr.dosage(F.col("g"))).collect()] == [0, 1, 1, 2, None, None, None, None, None]
    nums = spark.createDataFrame([("nan",), ("NaN",), (".",), ("1.5",), ("",), (None,)], "t string")
    assert [r[0] for r in nums.select(expr.clean_num(F.col("t"))).collect()] == [None, None, None, 1.5, None, None]
    ad = spark.createDataFrame([([3, 1],), ([0, 0],), ([5],)], "ad array<int>")
    assert [r[0] for r in ad.where("size(ad) > 1").select(expr.allele_fraction(F.col("ad"))).collect()] == [0.25, None]
    assert spark.range(1).select(expr.maf(F.lit(1.2))).first()[0] == 0


def test_left_align(spark):
    seq = spark.createDataFrame([("chr1", 0, "GGGCACACACATT".ljust(1000, "A"))], "chrom string, chunk long, seq string")
    rows = spark.createDataFrame([("chr1", 8, "CAC", "C"), ("chr1", 2, "GGT", "GGA"), ("chr1", 5, "A", "AA")], "chrom string, pos long, ref string, alt string")
    got = {(r.pos, r.ref, r.alt) for r in reference.left_align(rows, seq).collect()}
    assert got == {(3, "GCA", "G"), (4, "T", "A"), (4, "C", "CA")}


def test_merge_conflicts(spark):
    a = calls(spark, [(1, 1, 0), (1, 2, None), (1, 3, 1), (9, 1, 0)])
    b = calls(spark, [(1, 1, 0), (1, 2, 2), (1, 3, 2), (1, 4, 1)])
    assert {(r.sample_id, r.gt) for r in filters.merge_sets(a, b).collect()} == {(1, 0), (2, 2), (3, None), (4, 1)}


def test_ranges(spark):
    v = spark.createDataFrame([(1, "chr1", 99), (2, "chr1", 100), (3, "chr1", 2500), (4, "chr1", 2501), (5, "chr2", 150)], "variant_id long, chrom string, pos long")
    r = spark.createDataFrame([("chr1", 100, 2500)], "chrom string, start long, end long")
    assert sorted(x.variant_id for x in filters.exclude_ranges(v, r).collect()) == [1, 4, 5]


def random_calls(spark, seed=1, variants=12, samples=20):
    r = random.Random(seed)
    rows = [(v, s, r.choice([0, 0, 1, 1, 2, None]), r.choice([None, *range(1, 40)]), r.choice([None, *range(5, 50)]), r.choice([None, 0.05, 0.1, 0.2, 0.25, 0.5, 0.75, 0.9, 1.0]), r.choice([0, 1, 2, None])) for v in range(variants) for s in range(samples)]
    people = [(s, f"S{s}", 1 + s % 2, 1, ["15x", "30x", None][s % 3]) for s in range(samples)]
    return calls(spark, rows).cache(), spark.createDataFrame(people, schema.SAMPLES)


def test_grid_equals_single_runs(spark):
    c, s = random_calls(spark)
    grid = ([1, 8, 15, 30], [10, 20, 30], [0.0, 0.1, 0.25], [1.0, 0.75])
    whole = {(r.platform, r.dp, r.gq, r.laf, r.haf): r for r in concordance.concordance_grid(c, s, *grid).collect()}
    assert len(whole) == 3 * 4 * 3 * 3 * 2
    for dp, gq, laf, haf in [(1, 10, 0.0, 1.0), (8, 20, 0.25, 0.75), (30, 30, 0.1, 1.0)]:
        one = concordance.summarize(concordance.masked_confusion(c, s, dp, gq, laf, haf), concordance.masked_vmiss(c, s, dp, gq, laf, haf)).collect()
        for r in one:
            other = whole[r.platform, dp, gq, laf, haf].asDict()
            for k, v in r.asDict().items():
                assert other[k] == v or math.isclose(other[k], v, abs_tol=1e-9), (k, v, other[k])
    for r in whole.values():
        assert r.total_with_all_na == c.count() if r.platform == "ALL" else r.total_with_all_na < c.count()
    rates = [whole["ALL", dp, 10, 0.0, 1.0].vmiss_mean for dp in (1, 8, 15, 30)]
    assert rates == sorted(rates)


def test_zero_denominators(spark):
    c, s = random_calls(spark)
    got = concordance.summarize(concordance.masked_confusion(c.withColumn("gt", F.lit(None).cast("int")), s), concordance.masked_vmiss(c, s))
    assert all(r.total_genotype == 0 and r.concordance is None and r.fp_rate is None for r in got.collect())


def test_pareto_front(spark):
    r = random.Random(3)
    rows = [(i, r.randrange(6) / 5, r.randrange(6) / 5) for i in range(60)]
    got = {x.i for x in selection.pareto_front(spark.createDataFrame(rows, "i int, a double, b double"), "a", "b").collect()}
    assert got == {i for i, a, b in rows if not any(x >= a and y <= b and (x > a or y < b) for _, x, y in rows)}


def test_kneedle(spark):
    rows = [("g", x / 10, 1 - math.exp(-x)) for x in range(0, 60, 2)] + [("flat", 1.0, 1.0)]
    got = {r.g: r.knee_x for r in selection.kneedle(spark.createDataFrame(rows, "g string, x double, y double"), "x", "y", ["g"]).collect()}
    assert set(got) == {"g"} and 0.1 <= got["g"] <= 0.4


def test_pruning_leaves_no_correlated_pair(spark):
    r = random.Random(5)
    base = [[r.choice([0, 1, 2]) for _ in range(40)] for _ in range(4)]
    rows = [(v, s, base[v % 4][s] if r.random() > 0.1 else r.choice([0, 1, 2])) for v in range(24) for s in range(40)]
    c = calls(spark, rows)
    v = spark.createDataFrame([(i, "chr1", i, "A", "C", "PASS", 60.0, 20.0) for i in range(24)], schema.VARIANTS)
    kept = linkage.ld_prune(c, v, 50, 0.2)
    ids = {x.variant_id for x in kept.collect()}
    assert 0 < len(ids) < 24
    left = filters.keep(v, kept, "variant_id")
    assert linkage.correlations(c, left).where("r2 > 0.2").count() == 0
    linked = linkage.correlations(c, v).where("r2 > 0.2").collect()
    near = {i: {x.v2 for x in linked if x.v1 == i} | {x.v1 for x in linked if x.v2 == i} for i in range(24)}
    assert all(near[i] & ids for i in range(24) if i not in ids)


def test_bit_planes_give_plain_correlations(spark):
    """Pairs of every distance below the window, across blocks of ranks and of samples, with missing calls and gaps."""
    r = random.Random(8)
    rows = [(v, s, r.choice([0, 1, 1, 2, None])) for v in range(-3, 27) for s in range(-70, 300) if v % 7 or s % 3]
    c = calls(spark, rows)
    v = spark.createDataFrame([(i, "chr1" if i < 20 else "chr2", i // 2, "A", "C", "PASS", 60.0, 20.0) for i in range(-3, 30)], schema.VARIANTS)
    by = {}
    for a, s, g in rows:
        if g is not None:
            by.setdefault(a, {})[s] = g
    ranks = {x.variant_id: (x.chrom, x.idx) for x in linkage.indexed(v).collect()}
    want = {}
    for a in by:
        for b in by:
            if ranks[a][0] == ranks[b][0] and 0 < ranks[b][1] - ranks[a][1] < 6:
                both = [(by[a][s], by[b][s]) for s in by[a] if s in by[b]]
                x, y = np.array(both, float).T
                want[a, b] = (len(both), round(float(np.corrcoef(x, y)[0, 1] ** 2), 9))
    planes = linkage.window_sums(linkage.bit_planes(c), linkage.indexed(v), 6, words=2)
    got = {(x.v1, x.v2): (x.n, round(x.r2, 9)) for x in linkage.correlations(c, v, 6).collect()}
    assert got == want and {(x.v1, x.v2): x.n for x in planes.collect()} == {k: n for k, (n, _) in want.items()}
    assert linkage.correlations(c.limit(0), v).count() == 0


@pytest.mark.parametrize("chain", [True, False])
def test_pruning_settles_chains_in_a_round_a_border(spark, monkeypatch, chain):
    """The kept set is that of the plain greedy rule; a chain of falling priorities takes no round for each node."""
    r, n = random.Random(3), 600
    prio = {i: (i if chain else r.randrange(40), i) for i in range(n)}
    pairs = [(i, i + 1) for i in range(n - 1)] if chain else [(i, i + r.randrange(1, 10)) for i in range(n - 10) for _ in range(2)]
    near = {i: set() for i in range(n)}
    for a, b in pairs:
        near[a].add(b)
        near[b].add(a)
    want = set()
    for i in sorted(prio, key=prio.get):
        if not near[i] & want:
            want.add(i)
    rounds = []
    monkeypatch.setattr(linkage, "written", lambda df, name: (rounds.append(name), shared.written(df, name))[1])
    nodes = spark.createDataFrame([(i, prio[i], None if i < 0 else "c", i) for i in range(n)], "variant_id long, prio struct<a:long,b:long>, chrom string, idx long")
    kept = linkage.prune_ranked(nodes, spark.createDataFrame(pairs, "v1 long, v2 long"), 10, stretch=100)
    assert {x.variant_id for x in kept.collect()} == want
    assert rounds.count("prune-round") <= n // 100 + 1
    none = linkage.prune_ranked(nodes, spark.createDataFrame([], "v1 long, v2 long"), 10)
    assert none.count() == n and linkage.prune_ranked(nodes.limit(0), spark.createDataFrame(pairs, "v1 long, v2 long"), 10).count() == 0


def test_cover_touches_every_pair(spark):
    r = random.Random(6)
    pairs = sorted({tuple(sorted(r.sample(range(30), 2))) for _ in range(35)})
    nodes = spark.createDataFrame([(i, i % 9 == 0, [0.0, 0.01, None][i % 3]) for i in range(30)], "id long, is_case boolean, f_miss double")
    gone = {x.id for x in kinship.relative_removal(spark.createDataFrame(pairs, "id1 long, id2 long"), nodes).collect()}
    assert all(a in gone or b in gone for a, b in pairs)
    assert not any(i % 9 == 0 for i in gone)


def plain_cover(spark, pairs, weight):
    """The local-ratio rule, one pair after another in order of the hash, less what it does not need."""
    rows = spark.createDataFrame(pairs, "id1 long, id2 long").selectExpr("xxhash64(id1, id2) AS h", "id1", "id2").collect()
    left, gone = dict(weight), set()
    for _, a, b in sorted((r.h, r.id1, r.id2) for r in rows):
        if a not in gone and b not in gone:
            out, stays = (b, a) if left[b] <= left[a] else (a, b)
            gone.add(out)
            left[stays] -= left[out]
    near = {i: {b for a, b in pairs if a == i} | {a for a, b in pairs if b == i} for i in gone}
    free = {i for i in gone if near[i] <= gone}
    for i in sorted(free, key=lambda i: (-weight[i], i)):
        if not any(j in free and j not in gone for j in near[i]):
            gone.discard(i)
    return gone


def test_cover_equals_one_pair_after_another(spark):
    r = random.Random(11)
    pairs = sorted({tuple(sorted(r.sample(range(60), 2))) for _ in range(140)} | {(k, k + 1) for k in range(70, 100)})
    miss = {i: [0.0, 0.01, None, 0.02][i % 4] for i in range(101)}
    nodes = spark.createDataFrame([(i, i % 9 == 0, miss[i]) for i in range(101)], "id long, is_case boolean, f_miss double")
    weight = {i: kinship.CASE_WEIGHT if i % 9 == 0 else 1 / max(0.001 if miss[i] is None else miss[i], kinship.LEAST_MISS) for i in range(101)}
    gone = {x.id for x in kinship.relative_removal(spark.createDataFrame(pairs, "id1 long, id2 long"), nodes).collect()}
    assert gone == plain_cover(spark, pairs, weight)
    assert all(a in gone or b in gone for a, b in pairs) and all(any(i in p and not gone >= set(p) for p in pairs) for i in gone)


def test_cover_takes_few_rounds(spark, monkeypatch):
    """An id of many pairs does not take a round for each of them, and parts of the pairs in order of the hash give the same."""
    r = random.Random(5)
    pairs = sorted({(0, k) for k in range(1, 60)} | {tuple(sorted(r.sample(range(40), 2))) for _ in range(300)})
    nodes = spark.createDataFrame([(i, i % 9 == 0, 0.01 + i / 500) for i in range(60)], "id long, is_case boolean, f_miss double")
    want = plain_cover(spark, pairs, {i: kinship.CASE_WEIGHT if i % 9 == 0 else 1 / (0.01 + i / 500) for i in range(60)})
    rounds = []
    monkeypatch.setattr(kinship, "written", lambda df, name: (rounds.append(name), shared.written(df, name))[1])
    look = lambda: {x.id for x in kinship.relative_removal(spark.createDataFrame(pairs, "id1 long, id2 long"), nodes).collect()}
    assert look() == want and rounds.count("cover-paid") == 1
    monkeypatch.setattr(kinship, "ORDERED", 40)
    monkeypatch.setattr(linkage, "ORDERED", 2)
    rounds.clear()
    assert look() == want and 1 < rounds.count("cover-paid") < 20
    named = [(f"s{a}", f"s{b}") for a, b in pairs]
    gone = {x.id for x in kinship.relative_removal(spark.createDataFrame(named, "id1 string, id2 string"), nodes.withColumn("id", F.concat(F.lit("s"), F.col("id").cast("string")))).collect()}
    assert all(a in gone or b in gone for a, b in named)


def test_one_end_of_a_tied_pair_goes(spark):
    nodes = spark.createDataFrame([(1, False, 0.01), (2, False, 0.01), (3, True, 0.5), (4, True, 0.1), (5, False, 0.3), (6, True, 0.3)], "id long, is_case boolean, f_miss double")
    gone = kinship.relative_removal(spark.createDataFrame([(1, 2), (4, 3), (6, 5), (5, 5)], "id1 long, id2 long"), nodes)
    assert sorted(x.id for x in gone.collect()) == [2, 4, 5]
    assert kinship.relative_removal(spark.createDataFrame([], "id1 long, id2 long"), nodes).count() == 0


def test_reference_letters_across_chunks(spark):
    seq = "".join("ACGT"[(7 * k + k // 3) % 4] for k in range(40))
    chunks = spark.createDataFrame([("chr1", k, seq[10 * k : 10 * k + 10]) for k in range(4)], "chrom string, chunk long, seq string")
    rows = spark.createDataFrame([(1, "chr1", 8, seq[7:29], "A"), (2, "chr1", 10, seq[9], "A"), (3, "chr1", 38, seq[37:] + "AC", "A"), (4, "chr2", 3, "AC", "A")], "variant_id long, chrom string, pos long, ref string, alt string")
    got = {r.variant_id: r.ref_base for r in reference.with_base(rows, chunks, 10).collect()}
    assert got == {1: seq[7:29], 2: seq[9], 3: None, 4: None}


def test_left_align_goes_as_far_as_the_repeat(spark):
    seq = "G" + "CA" * 30 + "T"
    chunks = spark.createDataFrame([("chr1", k, seq[5 * k : 5 * k + 5]) for k in range(13)], "chrom string, chunk long, seq string")
    rows = spark.createDataFrame([(1, "chr1", 61, "A", "ACA"), (2, "chr1", 58, "CACA", "CA"), (3, "chr1", 30, "C", "T")], "variant_id long, chrom string, pos long, ref string, alt string")
    got = {r.variant_id: (r.pos, r.ref, r.alt) for r in reference.left_align(rows, chunks, 5).collect()}
    assert got == {1: (1, "G", "GCA"), 2: (1, "GCA", "G"), 3: (30, "C", "T")}


def test_both_ways_of_components_agree(spark, monkeypatch):
    """A cohort of three groups, so that its first components stand out, in many tiles."""
    from callgrove.operators import linalg, tiles

    monkeypatch.setattr(tiles.blocks_of, "__defaults__", (16,))
    r = np.random.default_rng(4)
    p = r.uniform(0.1, 0.9, (3, 150))
    rows = [(v, s, int(r.binomial(2, p[s % 3, v])) if r.random() > 0.03 else None) for v in range(150) for s in range(50)]
    c = calls(spark, [(v, s * 7 - 20, g) for v, s, g in rows])
    one, two = linalg.pca(c, 2), linalg.pca(c, 2, method="approximate")
    for a, b, key in zip(one, two, ("sample_id", "pc", "variant_id"), strict=True):
        assert np.allclose(a.orderBy(key).toPandas().to_numpy(float), b.orderBy(key).toPandas().to_numpy(float), atol=1e-6)
    flat = linalg.pca(c, 10, method="approximate")  # further components hardly differ, but they are orthonormal
    v = flat[0].orderBy("sample_id").toPandas().to_numpy(float)[:, 1:]
    assert np.allclose(v.T @ v, np.eye(10), atol=1e-9)
    monkeypatch.setattr(linalg, "EXACT_SAMPLES", 10)
    with pytest.raises(ValueError):
        linalg.pca(c, 2)


def test_components_beyond_the_exact_way(spark, monkeypatch):
    """More samples than the exact way takes: `auto` comes near by subspace iteration; sparse neighbours share few tiles."""
    from callgrove.operators import linalg, tiles

    monkeypatch.setattr(tiles.blocks_of, "__defaults__", (16,))
    r = np.random.default_rng(14)
    p = r.uniform(0.1, 0.9, (2, 160))
    c = calls(spark, [(v, s, int(r.binomial(2, p[s % 2, v]))) for v in range(160) for s in range(48) if r.random() < 0.6])
    exact = linalg.pca(c, 1, method="auto")
    monkeypatch.setattr(linalg, "EXACT_SAMPLES", 10)
    got = linalg.pca(c, 1, method="auto")
    for a, b, key in zip(exact, got, ("sample_id", "pc", "variant_id"), strict=True):
        assert np.allclose(a.orderBy(key).toPandas().to_numpy(float), b.orderBy(key).toPandas().to_numpy(float), atol=1e-4)  # six passes, not a limit
    apart = calls(spark, [(v, 16 * (v // 16) + s, 1) for v in range(160) for s in range(0, 16, 3)])
    variants, samples = tiles.blocks_of(apart, "variant_id", 16), tiles.blocks_of(apart, "sample_id", 6)
    assert tiles.tiled(apart, "gt", variants, samples).count() == 10 and variants.groupBy("block").count().where("count <> 16").count() == 0


def test_subspace_by_variants_stores_no_products(spark, monkeypatch):
    """Scattered calls: products of variants are never stored, and both kinds of passes agree."""
    from callgrove.operators import linalg, tiles

    monkeypatch.setattr(tiles.blocks_of, "__defaults__", (16,))
    monkeypatch.setattr(linalg, "PACK", 50)
    r = np.random.default_rng(24)
    p = r.uniform(0.1, 0.9, (2, 120))
    c = calls(spark, [(v, s, int(r.binomial(2, p[s % 2, v]))) for v in range(120) for s in range(40) if r.random() < 0.5])
    made = []
    monkeypatch.setattr(linalg, "written", lambda df, name: (made.append(name), shared.written(df, name))[1])
    one = [x.orderBy(x.columns[0]).toPandas().to_numpy(float) for x in linalg.pca(c, 1, method="approximate")]
    assert made.count("pca-back") == 6 and not {"tiles", "pca-products"} & set(made)
    monkeypatch.setattr(linalg, "VECTORS", 0)
    two = [x.orderBy(x.columns[0]).toPandas().to_numpy(float) for x in linalg.pca(c, 1, method="approximate")]
    assert "pca-products" in made and all(np.allclose(a, b, atol=1e-6) for a, b in zip(one, two, strict=True))


def test_tile_products(spark):
    """Dense or not, a tile's product is the matrix's."""
    from callgrove.operators import tiles

    r = np.random.default_rng(15)
    for share in (0.0, 0.02, 0.9):
        m = r.normal(size=(40, 30)) * (r.random((40, 30)) < share)
        i, j = np.nonzero(m)
        order = r.permutation(len(i))
        i, j = i[order], j[order]
        sides = i.astype("<i2").tobytes(), j.astype("<i2").tobytes(), m[i, j].tobytes()
        assert np.allclose(tiles.times(*sides, 40, 30, np.eye(30)), m) and np.allclose(tiles.times(sides[1], sides[0], sides[2], 30, 40, np.eye(40)), m.T)


def test_components_of_dependent_samples(spark):
    """Fewer directions than asked for: samples that are copies of two."""
    from callgrove.operators import linalg

    r = np.random.default_rng(5)
    g = r.integers(0, 3, (60, 2))
    c = calls(spark, [(v, s, int(g[v, s % 2])) for v in range(60) for s in range(6)])
    scores, values, weights = linalg.pca(c, 4, method="approximate")
    exact = linalg.pca(c, 4)[1].orderBy("pc").toPandas()["eigenvalue"].to_numpy()
    got = values.orderBy("pc").toPandas()["eigenvalue"].to_numpy()
    assert np.allclose(got, exact[: len(got)], atol=1e-8) and np.allclose(exact[len(got) :], 0, atol=1e-8)
    assert scores.count() == 6 and weights.count() > 0


def test_ranks_and_quantiles_beside_an_outlier(spark):
    """One value of 1e12, a large group, ties, missing values, a group of one, and a null group, over several partitions."""
    r = random.Random(12)
    rows = [("a", r.gauss(0, 1)) for _ in range(3000)] + [("a", 1e12), ("a", -0.0)] + [("b", float(r.randrange(5))) for _ in range(200)] + [("c", 7.0), ("d", None), (None, 1.0), (None, 3.0)]
    df = spark.createDataFrame(rows, "g string, x double").repartition(5)
    by = {}
    for g, x in rows:
        if x is not None:
            by.setdefault(g, []).append(x)
    probs = [0.0, 0.025, 0.25, 0.5, 0.975, 1.0]
    got = {x.g: x.q for x in stats.quantiles(df, "x", probs, ["g"]).collect()}
    assert got.keys() == by.keys() and all(np.allclose(got[g], np.quantile(v, probs), rtol=1e-12, atol=1e-12) for g, v in by.items())
    assert np.allclose(stats.quantiles(df, "x", probs).first().q, np.quantile([x for v in by.values() for x in v], probs), rtol=1e-12, atol=1e-12)
    middle = {x.g: x.median for x in stats.moments(df, "x", ["g"]).collect()}
    assert middle.pop("d") is None and all(middle[g] == pytest.approx(np.median(v)) for g, v in by.items())
    ranks = {(x.g, x.x): x.rank for x in stats.rank_avg(df.where("x IS NOT NULL"), "x", ["g"]).collect()}
    for g, v in by.items():
        for x in set(v[:50]):
            assert ranks[g, x] == sum(y < x for y in v) + (sum(y == x for y in v) + 1) / 2
    assert stats.quantiles(df.limit(0), "x", probs, ["g"]).count() == 0 and stats.rank_avg(df.limit(0), "x", ["g"]).count() == 0


def test_places_count_over_partitions(spark):
    r = random.Random(2)
    rows = [(r.choice([None, "chr2", "chr10", "chr1"]), r.randrange(50), k) for k in range(500)]
    df = spark.createDataFrame(rows, "chrom string, pos long, variant_id long").repartition(7)
    got = selection.placed(df, [selection.by_number(F.col("chrom")), F.col("pos"), F.col("variant_id")]).collect()
    number = lambda c: 1000 if c is None else int(c[3:])
    assert {(x.chrom, x.pos, x.variant_id): x.place for x in got} == {row: k for k, row in enumerate(sorted(rows, key=lambda x: (number(x[0]), *x[1:])), 1)}
    assert selection.placed(df.limit(0), [F.col("pos")]).count() == 0


def test_folders_are_removed(spark):
    from callgrove.shared import remove_intermediates, written

    table = written(spark.range(5), "gone")
    path = table.inputFiles()[0]
    assert remove_intermediates(spark) > 0
    import os

    assert not os.path.exists(path.removeprefix("file://"))


def test_duplicates_share_everything(spark):
    r = random.Random(7)
    rows = [(v, s, r.choice([0, 1, 2]) if s < 8 else None) for v in range(400) for s in range(9)]
    same = [(v, 8, next(g for a, s, g in rows if (a, s) == (v, 0))) for v in range(400)]
    got = kinship.pi_hat(calls(spark, [x for x in rows if x[1] < 8] + same), kinship.sample_pairs(calls(spark, [x for x in rows if x[1] < 8] + same), block=3)).collect()
    assert len(got) == 36
    assert {(x.id1, x.id2): round(x.pi_hat, 6) for x in got}[(0, 8)] == 1.0
    assert max(x.pi_hat for x in got if (x.id1, x.id2) != (0, 8)) < 0.5


def test_pairs_of_many_blocks_equal_plain_counts(spark):
    """Blocks of a few samples and variants, missing calls, samples and variants without any, and ids that are strings."""
    r = random.Random(11)
    rows = [(v, s, r.choice([0, 1, 2, None])) for v in range(90) for s in range(-4, 19) if s != 3 and v != 5 and (v + s) % 3]
    rows += [(5, s, None) for s in range(6)] + [(v, 40, 1) for v in range(3)] + [(99, 41, 2)]
    by = {}
    for v, s, g in rows:
        if g is not None:
            by.setdefault(s, {})[v] = g
    want = {}
    for a in by:
        for b in by:
            n = [sum(2 - abs(by[a][v] - by[b][v]) == k for v in by[a] if v in by[b]) for k in range(3)]
            if a < b and sum(n):
                want[a, b] = n
    c = calls(spark, rows)
    got = {(x.id1, x.id2): [x.n0, x.n1, x.n2] for x in kinship.sample_pairs(c, block=4, variants=20).collect()}
    assert got == want
    named = c.withColumn("sample_id", F.concat(F.lit("s"), F.col("sample_id").cast("string")))
    assert {frozenset((x.id1, x.id2)): [x.n0, x.n1, x.n2] for x in kinship.sample_pairs(named, block=4).collect()} == {frozenset((f"s{a}", f"s{b}")): n for (a, b), n in want.items()}
    full = {(x.id1, x.id2): x.pi_hat for x in kinship.pi_hat(c).collect()}
    near = {(x.id1, x.id2): x.pi_hat for x in kinship.pi_hat(c, above=0.1).collect()}
    assert set(near) <= set(full) and {k for k, x in full.items() if x is not None and round(x, 3) > 0.1} <= set(near) and len(near) < len(full)
    assert kinship.sample_pairs(c.limit(0)).count() == 0 and kinship.pi_hat(c.limit(0), above=0.1).count() == 0


def test_listed_pairs_equal_products(spark, monkeypatch):
    """Few calls a variant: pairs are listed, in squares of samples or not, in chunks of one variant, and with a bound."""
    from callgrove.operators import tiles

    r = random.Random(12)
    rows = [(v, 100 * (v // 50) + s, r.choice([0, 1, 2])) for v in range(200) for s in r.sample(range(40), 6)]
    c = calls(spark, rows)
    look = lambda df: {(x.id1, x.id2): [x.n0, x.n1, x.n2] for x in df.collect()}
    want = look(kinship.multiplied_pairs(c, 16, 64))
    monkeypatch.setattr(tiles, "blocks_of", lambda *_: pytest.fail("sparse calls are not multiplied"))
    assert look(kinship.sample_pairs(c)) == want
    few = lambda n: n.sum(0) > 3
    assert look(kinship.sample_pairs(c, keep=few)) == {k: n for k, n in want.items() if sum(n) > 3} != want
    monkeypatch.setattr(kinship, "SQUARE", 3)
    monkeypatch.setattr(kinship, "LISTED", 7)
    monkeypatch.setattr(kinship, "CHUNK", 5)
    assert look(kinship.sample_pairs(c)) == want
    named = c.withColumn("sample_id", F.concat(F.lit("s"), F.col("sample_id").cast("string")))
    assert {frozenset(k): n for k, n in look(kinship.sample_pairs(named)).items()} == {frozenset((f"s{a}", f"s{b}")): n for (a, b), n in want.items()}


def test_logistic_scan(spark):
    r = random.Random(8)
    rows, pheno = [], []
    for s in range(300):
        g = r.choice([0, 1, 2])
        rows += [(1, s, g), (2, s, 1), (3, s, None)]
        pheno.append((s, 2 if r.random() < 1 / (1 + math.exp(-(g - 1))) else 1, float(r.random())))
    p = spark.createDataFrame(pheno, "sample_id long, pheno int, pc1 double")
    got = {x.variant_id: x for x in association.logistic_scan(calls(spark, rows), p.select("sample_id", "pheno"), p.select("sample_id", "pc1"), ["pc1"]).collect()}
    assert got[1].errcode == "." and 1.8 < got[1].odds_ratio < 4.5 and got[1].ci_low < got[1].odds_ratio < got[1].ci_high
    assert got[2].errcode == "CONST_ALLELE" and got[2].p is None and 3 not in got


def plain_fit(x, y):
    w = np.zeros(x.shape[1])
    for _ in range(25):
        p = 1 / (1 + np.exp(-x @ w))
        h = (x * (p * (1 - p))[:, None]).T @ x
        move = np.linalg.solve(h, x.T @ (y - p))
        w = w + move
        if np.abs(move).max() < 1e-9:
            return w[0], np.sqrt(np.linalg.inv(h)[0, 0])
    return None


def test_logistic_scan_in_tiles_equals_plain_fits(spark, monkeypatch):
    """Many small tiles, missing calls, a covariate that does not vary at all, and one that does not within a variant."""
    from callgrove.operators import tiles

    monkeypatch.setattr(tiles.blocks_of, "__defaults__", (20,))
    r = np.random.default_rng(6)
    people = [(s, 2 if r.random() < 0.4 else 1, float(r.normal(50, 20)), float(s % 2), 3.0) for s in range(130)]
    rows = [(v, s, int(r.integers(0, 3)) if r.random() > 0.1 else None) for v in range(40) for s in range(130) if v != 7 or s % 2]
    rows += [(100, s, int(people[s][1] == 2)) for s in range(130)] + [(101, s, s % 3) for s in range(130) if people[s][1] == 1] + [(102, s, 1) for s in range(130)]
    p = spark.createDataFrame(people, "sample_id long, pheno int, age double, sex double, same double")
    got = {x.variant_id: x for x in association.logistic_scan(calls(spark, rows), p.select("sample_id", "pheno"), p.drop("pheno"), ["age", "sex", "same"]).collect()}
    for v in range(40):
        own = [(g, *people[s][1:4]) for a, s, g in rows if a == v and g is not None]
        g, y, age, sex = np.array(own, float).T
        x = np.column_stack([g, np.ones(len(g)), (age - 50) / 20, sex][: 3 if v == 7 else 4])
        beta, se = plain_fit(x, (y == 2).astype(float))
        assert (got[v].n, got[v].errcode) == (len(own), ".") and got[v].beta == pytest.approx(beta, abs=1e-7) and got[v].se == pytest.approx(se, abs=1e-6)
        assert got[v].p == pytest.approx(math.erfc(abs(beta / se) / math.sqrt(2)), abs=1e-6)
    assert [got[v].errcode for v in (100, 101, 102)] == ["UNFINISHED", "NO_CONTRAST", "CONST_ALLELE"] and got[100].beta is None


def test_light_and_heavy_fits_agree(spark, monkeypatch):
    """Variants below a number of calls are fitted in one task, no tile is made for them; the others give the same by tiles."""
    from callgrove.operators import tiles

    r = np.random.default_rng(16)
    p = spark.createDataFrame([(s, 2 if r.random() < 0.4 else 1, float(r.normal(50, 20)), float(s % 2)) for s in range(90)], "sample_id long, pheno int, age double, sex double")
    c = calls(spark, [(v, s, int(r.integers(0, 3))) for v in range(30) for s in range(90) if r.random() < (0.9 if v % 2 else 0.5)])
    run = lambda: {x.variant_id: x for x in association.logistic_scan(c, p.select("sample_id", "pheno"), p.drop("pheno"), ["age", "sex"]).collect()}
    made = tiles.blocks_of
    monkeypatch.setattr(association, "TOGETHER", 150)
    monkeypatch.setattr(tiles, "blocks_of", lambda *_: pytest.fail("light variants have no tiles"))
    light = run()
    monkeypatch.setattr(tiles, "blocks_of", made)
    for least in (0, 60):
        monkeypatch.setattr(association, "LIGHT", least)
        mixed = run()
        assert set(mixed) == set(light) and len({x.errcode for x in mixed.values()}) >= 1
        for v, x in mixed.items():
            assert (x.n, x.errcode) == (light[v].n, light[v].errcode) and (x.beta is None or (x.beta, x.se, x.p) == pytest.approx((light[v].beta, light[v].se, light[v].p), abs=1e-7))


def test_pca_matches_numpy(spark):
    from callgrove.operators import linalg

    r = np.random.default_rng(9)
    g = r.integers(0, 3, (200, 15))
    c = calls(spark, [(int(v), int(s), int(g[v, s])) for v in range(200) for s in range(15)])
    scores, values, weights = linalg.pca(c, 3)
    p = g.mean(1, keepdims=True) / 2
    z = (g - 2 * p) / np.sqrt(2 * p * (1 - p))
    s = np.linalg.svd(z, compute_uv=False)
    assert [x.eigenvalue for x in values.orderBy("pc").collect()] == pytest.approx((s**2 / 200)[:3])
    v = np.array([[x.pc1, x.pc2, x.pc3] for x in scores.orderBy("sample_id").collect()])
    u = np.array([[x.pc1, x.pc2, x.pc3] for x in weights.orderBy("variant_id").collect()])
    assert np.allclose(z @ v, u * s[:3], atol=1e-8)


def test_sparse_pairs_match_bit_planes(spark, monkeypatch):
    """Variants of few calls meet by sample in one task, across blocks of ranks; the bound is applied there."""
    r = random.Random(9)
    monkeypatch.setattr(linkage, "SPARSE_RANKS", 8)
    c = calls(spark, [(v, s, r.choice([0, 1, 2, None])) for v in range(40) for s in r.sample(range(60), 12)])
    v = spark.createDataFrame([(i, "chr1" if i < 30 else None, i // 2, "A", "C", "PASS", 60.0, 20.0) for i in range(41)], schema.VARIANTS)
    plain = lambda rows: {(x.v1, x.v2): (x.n, x.r2) for x in rows.collect()}
    sparse, above = plain(linkage.correlations(c, v, 6)), plain(linkage.correlations(c, v, 6, 0.5))
    monkeypatch.setattr(linkage, "SPARSE_CALLS", 0)
    assert sparse == plain(linkage.correlations(c, v, 6)) and any(x[1] is None for x in sparse.values())
    assert above == {k: x for k, x in sparse.items() if x[1] is not None and x[1] > 0.5} == plain(linkage.correlations(c, v, 6, 0.5))


def test_tasks_grow_with_rows(spark, monkeypatch):
    monkeypatch.setattr(shared, "LEAST_ROWS", 10)
    monkeypatch.setattr(shared, "TASK_ROWS", 50)
    assert shared.dealt(spark.range(1000), "id").rdd.getNumPartitions() == 20
    assert shared.dealt(spark.range(5), "id").rdd.getNumPartitions() == 1
    assert shared.dealt(spark.range(0), "id").count() == 0


def test_missing_rate_grid_by_brute_force(spark, monkeypatch):
    """Variants of several blocks and packs, counts sent on early, with NULLs and a depth that only some have."""
    monkeypatch.setattr(concordance, "PACK_ROWS", 40)
    monkeypatch.setattr(concordance, "BLOCK", 3)
    monkeypatch.setattr(concordance, "SLICE", 5)
    monkeypatch.setattr(concordance.tiles, "HELD", 2000)
    r = random.Random(4)
    rows = [(v, s, r.choice([0, 1, 2, None]), r.choice([2, 9, 40, None]), r.choice([5, 15, 25, None]), r.choice([0.1, 0.4, 0.9, None])) for v in range(20) for s in range(12) if r.random() < 0.7]
    depth = {s: ["15x", "30x", None][s % 3] for s in range(12)}
    samples = spark.createDataFrame([(s, str(s), 1, 1, d) for s, d in depth.items()], schema.SAMPLES)
    grid = ([5, 10], [10, 20], [0.0, 0.3], [1.0, 0.5])
    got = {(x.platform, x.dp, x.gq, x.laf, x.haf): (x.vmiss_mean, x.vmiss_median, x.vmiss_sd) for x in concordance.vmiss_grid(calls(spark, rows), samples, *grid).collect()}
    assert len(got) == 3 * 16
    for (platform, dp, gq, laf, haf), found in got.items():
        of = {}
        for v, s, gt, d, q, af in rows:
            if platform == "ALL" or (depth[s] or "").upper() == platform:
                gone = gt is None or (d is not None and d < dp) or (q is not None and q < gq) or (gt == 1 and af is not None and not laf <= af <= haf)
                of.setdefault(v, []).append(gone)
        rates = [math.floor(10_000 * sum(x) / len(x) + 0.5) / 10_000 for x in of.values()]
        assert np.allclose(found, (np.mean(rates), np.median(rates), np.std(rates, ddof=1)), atol=1e-9)
    assert concordance.vmiss_grid(calls(spark, rows).limit(0), samples, *grid).count() == 0


@pytest.mark.parametrize("name", ["jon10_merge_sets", "pip9_array_truth", "pip9_array_truth_normalised", "pip10_tune", "pip1_wgs_select_raw"])
def test_calls_are_derived_once(spark, name):
    """What a query returns reads what was written of the calls; the rows that they come from are read once before."""
    import __spark_entry__

    got = __spark_entry__.queries()[name](spark, "/root/testdata/sf0.001")
    assert not [x for x in got.inputFiles() if "lineitem" in x]
