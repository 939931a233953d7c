"""Text formats: a small call file by hand, matrices and stores."""

from callgrove.sources import tables, vcf

LINES = """##fileformat=VCFv4.2
#CHROM	POS	ID	REF	ALT	QUAL	FILTER	INFO	FORMAT	s1	s2	s3
chr1	10	a	A	C	50	PASS	MQ=60;VQSLOD=12.5	GT:DP:GQ:AF:AD	0/0:10:30:0.0:10,0	0|1:12:40:0.5:6,6	1/1:9:20:1.0:0,9
chr1	20	.	A	C,G	.	LowQual	MQ=.;DB	GT:DP	0/2:5	./1:4	./.
chr1	30	c	G	T	nan	.	VQSLOD=-1	GT:DP:GQ	1|0	.:.:.	0/1:7
"""


def test_vcf(spark, tmp_path):
    path = tmp_path / "x.vcf"
    path.write_text(LINES)
    got = {(r.pos, r["sample"]): r for r in vcf.read_vcf(spark, str(path)).collect()}
    assert len(got) == 9
    assert [got[10, s].gt for s in ("s1", "s2", "s3")] == [0, 1, 2]
    assert (got[10, "s2"].dp, got[10, "s2"].gq, got[10, "s2"].af, got[10, "s2"].ad) == (12, 40, 0.5, [6, 6])
    assert [got[20, s].gt for s in ("s1", "s2", "s3")] == [None, None, None] and got[20, "s1"].dp == 5 and got[20, "s3"].dp is None and got[20, "s1"].alts == ["C", "G"]
    assert got[30, "s1"].gt == 1 and got[30, "s1"].dp is None and got[30, "s2"].dp is None and got[30, "s3"].dp == 7
    sites = vcf.sites(spark, str(path)).select("pos", "qual", "filter", "id", vcf.info_field("MQ").alias("mq"), vcf.info_field("VQSLOD").alias("v")).orderBy("pos").collect()
    assert [tuple(r) for r in sites] == [(10, 50.0, "PASS", "a", 60.0, 12.5), (20, None, "LowQual", None, None, None), (30, None, None, "c", None, -1.0)]


def test_files_of_a_folder_have_their_own_headers(spark, tmp_path):
    """Other samples, another order, no samples at all, and a second file of the same samples."""
    line = lambda pos, *fields: "\t".join(["chr1", str(pos), ".", "A", "C", ".", "PASS", ".", "GT:DP", *fields])
    head = lambda *names: "##x\n" + "\t".join(["#CHROM", "POS", "ID", "REF", "ALT", "QUAL", "FILTER", "INFO", *(["FORMAT"] if names else []), *names])
    texts = {
        "a.vcf": [head("s1", "s2"), line(1, "0/0:1", "0/1:2"), line(2, "1/1:3", "0/0:4")], "b.vcf": [head("s2", "s3", "s1"), line(3, "0/1:5", "1/1:6", "0/0:7")],
        "c.vcf": [head(), "chr1\t4\t.\tA\tC\t.\tPASS\t."], "d.vcf": [head("s1", "s2"), line(5, "1/1:8", "0/1:9", "0/0:10")],
    }
    for name, lines in texts.items():
        (tmp_path / name).write_text("\n".join(lines) + "\n")
    got = sorted((r.pos, r["sample"] or "", r.gt, r.dp) for r in vcf.read_vcf(spark, str(tmp_path)).collect())
    assert got == [(1, "s1", 0, 1), (1, "s2", 1, 2), (2, "s1", 2, 3), (2, "s2", 0, 4), (3, "s1", 0, 7), (3, "s2", 1, 5), (3, "s3", 2, 6), (5, "", 0, 10), (5, "s1", 2, 8), (5, "s2", 1, 9)]
    assert vcf.sites(spark, str(tmp_path)).count() == 5
    (tmp_path / "parts").mkdir()
    (tmp_path / "parts" / "a.vcf").write_text(head("s1", "s2") + "\n")
    (tmp_path / "parts" / "b.vcf").write_text(line(1, "0/0:1", "0/1:2") + "\n")
    parts = lambda: {(r.pos, r["sample"], r.gt) for r in vcf.read_vcf(spark, str(tmp_path / "parts")).collect()}
    assert parts() == {(1, "s1", 0), (1, "s2", 1)}
    (tmp_path / "parts" / "c.vcf").write_text(head("s2", "s1") + "\n")
    assert parts() == {(1, None, 0), (1, None, 1)}


def test_text_tables(spark, tmp_path):
    (tmp_path / "a.txt").write_text("#ID  P\n 1   0.5\n2\tNA\n\n")
    rows = tables.read_ws(spark, str(tmp_path / "a.txt"), "id long, p double", "#ID").collect()
    assert [tuple(r) for r in rows] == [(1, 0.5), (2, None)]
    (tmp_path / "ids").write_text("x\n\n  \n y \n")
    assert [r.id for r in tables.read_ids(spark, str(tmp_path / "ids")).collect()] == ["x", "y"]


def test_matrix(spark, tmp_path):
    df = spark.createDataFrame([(1, 10, 5), (1, 11, None), (2, 11, 7)], "sample_id long, variant_id long, dp int")
    path = tables.write_matrix(df, "dp", [10, 11, 12], str(tmp_path / "m"))
    got = {(r.sample_id, r.variant_id): r.dp for r in tables.read_matrix_long(spark, path, "dp").collect()}
    assert got == {("1", "10"): 5.0, ("1", "11"): None, ("1", "12"): None, ("2", "10"): None, ("2", "11"): 7.0, ("2", "12"): None}


def test_matrix_of_all_blocks(spark, tmp_path):
    df = spark.createDataFrame([(1, 7, 5), (1, 13, None), (2, 13, 7), (1, 25, 2), (2, 26, 9), (2, 27, 1), (3, 29, 4)], "sample_id long, variant_id long, dp int")
    keys = spark.createDataFrame([(k,) for k in (7, 13, 25, 26, 27, 28, 29)], "variant_id long")
    path = tables.write_matrix_blocks(df, keys, "dp", str(tmp_path / "m"), width=10)
    got = {(r.sample_id, r.variant_id): r.dp for r in tables.read_matrix_blocks(spark, path, "dp").collect() if r.dp is not None}
    assert got == {("1", "7"): 5.0, ("2", "13"): 7.0, ("1", "25"): 2.0, ("2", "26"): 9.0, ("2", "27"): 1.0, ("3", "29"): 4.0}
    assert len(list((tmp_path / "m").glob("block=*"))) == 3


def test_matrix_queries_against_their_sql(spark):
    import duckdb

    from callgrove import catalog

    folder = "/root/testdata/sf0.001"
    duck = duckdb.connect()
    for name in ("supplier", "part", "lineitem"):
        duck.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    for name in ("src7_wide_matrix_scan", "src7_wide_matrix_scan_all", "snk2_wide_matrix_writer", "snk2_wide_matrix_writer_all"):
        got = catalog.queries()[name](spark, folder)
        want = duck.execute(f"SELECT {', '.join(got.columns)} FROM ({catalog.oracle_sql()[name]})").fetchall()
        assert sorted(map(tuple, got.collect())) == sorted(want), name


def test_sparse_call_text_has_own_headers(spark, tmp_path):
    """Files of ranges of variants name the samples called there alone, and absent pairs are read or left out."""
    import gzip

    calls = spark.createDataFrame([(1, 5, 0, 8, 30, 0.0), (1, 7, 1, 9, 20, 0.5), (2, 9, None, 4, None, None), (11, 7, 2, 6, 10, 1.0), (12, 30, 1, 3, 40, 0.4)], "variant_id long, sample_id long, gt int, dp int, gq int, af double")
    sites = spark.createDataFrame([(v, "chr1", 10 * v, "A", "C", "PASS", 60.0, 1.5) for v in (1, 2, 3, 11, 12)], "variant_id long, chrom string, pos long, ref string, alt string, filter string, mq double, vqslod double")
    path = vcf.write_vcf(sites, calls, str(tmp_path / "v"), width=10)
    files = [gzip.open(f, "rt").read().splitlines() for f in sorted((tmp_path / "v").glob("block=*/*.gz"))]
    assert [[line.split("\t")[9:] for line in f if line.startswith("#CHROM")] for f in files] == [[["5", "7", "9"]], [["7", "30"]]]
    assert all(f[0].startswith("##") and f[1].startswith("#CHROM") for f in files)
    want = {("1", "5", 0, 8, 30, 0.0), ("1", "7", 1, 9, 20, 0.5), ("2", "9", None, 4, None, None), ("11", "7", 2, 6, 10, 1.0), ("12", "30", 1, 3, 40, 0.4)}
    got = [(r.id, r["sample"], r.gt, r.dp, r.gq, r.af) for r in vcf.read_vcf(spark, path, absent=False).collect()]
    assert len(got) == 5 and set(got) == want
    assert vcf.read_vcf(spark, path).count() == 10 and vcf.sites(spark, path).count() == 4


def test_sparse_matrix_without_blanks(spark, tmp_path):
    df = spark.createDataFrame([(1, 7, 5), (1, 13, None), (2, 13, 7), (4, 8, None)], "sample_id long, variant_id long, dp int")
    keys = spark.createDataFrame([(k,) for k in (6, 7, 8, 13, 14)], "variant_id long")
    path = tables.write_matrix_blocks(df, keys, "dp", str(tmp_path / "m"), width=10)
    rows = tables.read_matrix_blocks(spark, path, "dp", blanks=False).collect()
    assert {(r.sample_id, r.variant_id, r.dp) for r in rows if r.variant_id} == {("1", "7", 5.0), ("2", "13", 7.0)}
    assert {r.sample_id for r in rows} == {"1", "2", "4"} and len(rows) == 2 + 4
    assert tables.read_matrix_blocks(spark, path, "dp").count() == 2 * 3 + 2 * 2 and list((tmp_path / "m").glob("block=*/*.gz"))


def test_ranges_of_a_sparse_matrix_are_narrow(spark, tmp_path, monkeypatch):
    """Where few samples share variants, fields are no more than FILL for each cell; one wide range would have the product of both."""
    import gzip

    monkeypatch.setattr(tables, "FILL", 4)
    cells = [(100 + 7 * v % 50, v, v % 9) for v in range(60)] + [(5, 61, 3), (5, 62, None)]
    df = spark.createDataFrame(cells, "sample_id long, variant_id long, dp int")
    keys = spark.createDataFrame([(k,) for k in range(70)], "variant_id long")
    path = tables.write_matrix_blocks(df, keys, "dp", str(tmp_path / "m"), width=100)
    lines = [line for f in (tmp_path / "m").glob("block=*/*.gz") for line in gzip.open(f, "rt").read().splitlines() if not line.startswith("sample_id")]
    assert sum(line.count("\t") for line in lines) <= 4 * len(cells)
    rows = tables.read_matrix_blocks(spark, path, "dp", blanks=False).collect()
    assert sorted((int(r.sample_id), int(r.variant_id), r.dp) for r in rows if r.dp is not None) == sorted((s, v, float(x)) for s, v, x in cells if x is not None)
    assert {(r.sample_id, r.variant_id, r.dp) for r in tables.read_matrix_blocks(spark, path, "dp").collect() if r.dp is not None} == {(r.sample_id, r.variant_id, r.dp) for r in rows if r.dp is not None}
    assert {r.sample_id for r in rows} == {str(s) for s, _, _ in cells} and len(rows) == 61 + len(lines)


def test_fields_that_say_something():
    import pyarrow as pa

    from callgrove.sources import fields

    lines = ["a\t\tb\t", "", "\t", "x", "\t\t./.\t.\t.|.\t0/1:3\t./1"]
    for dots in (False, True):
        line, place, text = fields.telling(pa.array(lines, pa.large_string()), dots)
        want = [(i, k, f) for i, one in enumerate(lines) for k, f in enumerate(one.split("\t")) if f and not (dots and f in (".", "./.", ".|."))]
        assert list(zip(line.tolist(), place.tolist(), text.to_pylist(), strict=True)) == want
    assert sum(len(p) for p in fields.parts_of(pa.array(lines, pa.large_string()))) == len(lines)


def test_whole_files_of_sparse_call_text(spark, tmp_path, monkeypatch):
    """Fields are no more than FILL for each call, and names come from the header above the lines; a file without one is an error."""
    import gzip

    import pytest

    monkeypatch.setattr(tables, "FILL", 4)
    calls = [(v, 100 + 7 * v % 50, v % 3, v % 9, 30, 0.5) for v in range(60)] + [(61, 5, None, None, None, None), (62, 5, None, 4, None, None)]
    df = spark.createDataFrame(calls, "variant_id long, sample_id long, gt int, dp int, gq int, af double")
    sites = spark.createDataFrame([(v, "chr1", 10 * v, "A", "C", "PASS", 60.0, 1.5) for v in range(70)], "variant_id long, chrom string, pos long, ref string, alt string, filter string, mq double, vqslod double")
    path = vcf.write_vcf(sites, df, str(tmp_path / "v"), width=100)
    lines = [line for f in (tmp_path / "v").glob("block=*/*.gz") for line in gzip.open(f, "rt").read().splitlines() if not line.startswith("#")]
    assert len(lines) == 62 and sum(line.count("\t") - 8 for line in lines) <= 4 * len(calls)
    look = lambda **how: sorted((int(r.id), int(r["sample"]), r.gt, r.dp, r.gq, r.af) for r in vcf.read_vcf(spark, path, **how).where("dp IS NOT NULL").collect())
    assert look(whole=True) == look() == sorted(c for c in calls if c[3] is not None)
    with gzip.open(tmp_path / "b.gz", "wt") as f:
        f.write(lines[0] + "\n")
    with pytest.raises(Exception, match="begin with its header"):
        vcf.read_vcf(spark, str(tmp_path / "b.gz"), whole=True).collect()
