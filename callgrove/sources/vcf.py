"""Variant call text: a scan to long calls, and the site columns alone."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from callgrove.functions.expr import clean_num, dosage
from callgrove.shared import sized, written
from callgrove.sources import fields
from callgrove.sources.tables import in_ranges

SITE = ["chrom", "pos", "id", "ref", "alt", "qual", "filter", "info", "format"]


def lines_of(spark: SparkSession, path: str) -> DataFrame:
    """Lines with the file that each is from."""
    return spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"))


def headers(spark: SparkSession, path: str) -> DataFrame:
    """(file, k, sample): the samples of each file's header line by their place; a file may have others, or another order, than the next."""
    found = lines_of(spark, path).where(F.col("value").startswith("#CHROM")).select("file", F.split("value", "\t").alias("h"))
    return found.select("file", F.posexplode(F.slice("h", 10, F.greatest(F.size("h") - 9, F.lit(0)))).alias("k", "sample")).dropDuplicates(["file", "k"])


def common_header(names: DataFrame) -> DataFrame:
    """(k, sample) of the header that all files with one have; empty if they differ."""
    by_place = names.groupBy("k").agg(F.min("sample").alias("sample"), F.max("sample").alias("last"), F.count("*").alias("n"))
    files = names.select("file").distinct().agg(F.count("*").alias("files"))
    same = by_place.crossJoin(F.broadcast(files)).agg(F.min((F.col("sample") == F.col("last")) & (F.col("n") == F.col("files"))).alias("same"))  # one row each
    return by_place.crossJoin(F.broadcast(same)).where("same").select("k", "sample")


def _site_columns(cells: Column) -> list[Column]:
    dot = lambda c: F.when(c != ".", c)
    return [
        cells[0].alias("chrom"), cells[1].cast("long").alias("pos"), dot(cells[2]).alias("id"), cells[3].alias("ref"), F.split(cells[4], ",").alias("alts"), clean_num(cells[5]).alias("qual"),
        dot(cells[6]).alias("filter"), F.str_to_map(cells[7], F.lit(";"), F.lit("=")).alias("info"), F.split(F.try_element_at(cells, F.lit(9)), ":").alias("format"),
    ]


def sites(spark: SparkSession, path: str) -> DataFrame:
    """Site columns and the file; the rest of each line stays an array of sample fields."""
    cells = F.split("value", "\t", 10)
    rows = lines_of(spark, path).where((F.col("value") != "") & ~F.col("value").startswith("#"))
    return rows.select(*_site_columns(cells), F.coalesce(F.split(F.try_element_at(cells, F.lit(10)), "\t"), F.array().cast("array<string>")).alias("fields"), "file")


def told_fields(spark: SparkSession, path: str) -> DataFrame:
    """site (its nine cells), sample and field: the fields that are not absent, of compressed files that begin with a header each.

    A compressed file is read by one task from its first line on, so names are those of the header that the task has seen: no
    header is joined, and absent fields, nearly all of a sparse file, never become rows.
    """
    text = lines_of(spark, path).where((F.col("value") != "") & (~F.col("value").startswith("#") | F.col("value").startswith("#CHROM")))
    cells = F.split("value", "\t", 10)
    rows = text.select(F.concat_ws("\t", F.slice(cells, 1, 9)).alias("site"), F.coalesce(F.try_element_at(cells, F.lit(10)), F.lit("")).alias("rest"), "file")

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, own = None, None
        for batch in batches:
            site, lines, files = batch.column(0), batch.column(1).cast(pa.large_string()), batch.column(2)
            starts = [*np.flatnonzero(pc.starts_with(site, "#CHROM").to_numpy(zero_copy_only=False)).tolist(), len(lines)]
            for k, stop in enumerate(starts):
                at = starts[k - 1] + 1 if k else 0
                if k:
                    names, own = pa.array(lines[at - 1].as_py().split("\t"), pa.string()), files[at - 1]
                if at < stop and (own is None or pc.any(pc.not_equal(files.slice(at, stop - at), own)).as_py()):
                    raise ValueError("a compressed file of call text does not begin with its header")
                for part in fields.parts_of(lines.slice(at, stop - at)):
                    line, place, said = fields.telling(part, dots=True)
                    named = pa.array(place, mask=place >= len(names))  # fields beyond the header have no name
                    yield pa.RecordBatch.from_arrays([site.take(pa.array(line + at)), names.take(named), said], names=["site", "sample", "field"])
                    at += len(part)

    return rows.mapInArrow(told, "site string, sample string, field string")


def read_vcf(spark: SparkSession, path: str, absent: bool = True, whole: bool = False) -> DataFrame:
    """Long calls: one row per site and sample, with dosage, depth, quality, allele depths and allele fraction.

    The dosage is that of the first alternate allele; other genotypes, half calls included, are NULL. Fields get their names from
    the header of their own file, by a join on file and place. A file without a header is a part of a set whose other files have one
    in common; where these differ, and beyond a header, fields have no name. Without absent pairs, fields of nothing but dots are left
    out before they get names; in a sparse file they are nearly all. With `whole`, files are compressed and begin with a header each, as
    write_vcf() makes them, so names come with the lines (absent fields are left out then).
    """
    if whole:
        return _calls_of(told_fields(spark, path).select(*_site_columns(F.split("site", "\t")), "sample", "field"))
    names = written(headers(spark, path), "headers")
    own = names.select(F.col("file").alias("of"), F.col("k").alias("at"), F.col("sample").alias("own"))
    whole = names.select(F.col("file").alias("headed")).distinct()
    rest = common_header(names).select(F.col("k").alias("place"), F.col("sample").alias("other"))
    split = sites(spark, path).join(sized(whole), F.col("file") == F.col("headed"), "left")
    split = split.withColumn("none", F.concat(F.lit("./."), F.repeat(F.lit(":."), F.size("format") - 1))).select("*", F.posexplode("fields").alias("k", "field"))
    split = split if absent else split.where((F.col("field") != F.col("none")) & ~F.col("field").isin(".", "./.", ".|."))
    long = split.join(sized(own), (F.col("headed") == F.col("of")) & (F.col("k") == F.col("at")), "left")
    long = long.join(sized(rest), F.col("headed").isNull() & (F.col("k") == F.col("place")), "left").withColumn("sample", F.coalesce("own", "other"))
    return _calls_of(long)


def _calls_of(long: DataFrame) -> DataFrame:
    """Calls of rows with the columns of a site, sample and field. A field is split once: each step's columns are what the next one reads."""
    names = ["GT", "DP", "GQ", "AF", "AD"]
    site = ["chrom", "pos", "id", "ref", "alts", "filter", "sample"]
    parts = long.select(*site, "format", F.split("field", ":").alias("parts"))
    at = {n: F.array_position("format", n).cast("int") for n in names}
    texts = parts.select(*site, *[F.when(at[n] > 0, F.try_element_at("parts", at[n])).alias(f"__{n}") for n in names])
    said = texts.select(*site, *[F.when(F.col(f"__{n}") != ".", F.col(f"__{n}")).alias(f"__{n}") for n in names])
    ad = F.transform(F.split("__AD", ","), lambda x: x.try_cast("int"))
    return said.select(*site[:-1], "sample", dosage(F.col("__GT")).alias("gt"), F.col("__DP").try_cast("int").alias("dp"), F.col("__GQ").try_cast("int").alias("gq"), clean_num(F.split("__AF", ",")[0]).alias("af"), ad.alias("ad"))


def info_field(name: str, kind: str = "double") -> Column:
    return F.try_element_at("info", F.lit(name)).try_cast(kind)


def write_vcf(variants: DataFrame, calls: DataFrame, path: str, width: int = 10_000) -> str:
    """Compressed call text, a file for each range of `width` ids with a header of the samples that have a call in it, in order of id.

    An absent pair is ./. alone. Ranges are narrower where nearly all pairs are absent. Only calls are shuffled: absent pairs come in as lines are written.
    """
    gt = F.when(F.col("gt") == 0, "0/0").when(F.col("gt") == 1, F.when(F.col("dp") % 2 == 0, "0/1").otherwise("0|1")).when(F.col("gt") == 2, "1/1").otherwise("./.")
    text = F.concat_ws(":", gt, F.coalesce(F.col("dp").cast("string"), F.lit(".")), F.coalesce(F.col("gq").cast("string"), F.lit(".")), F.coalesce(F.col("af").cast("string"), F.lit(".")))
    cells = written(calls.join(variants.select("variant_id"), "variant_id", "left_semi").select("variant_id", "sample_id", text.alias("t")), "vcf-cells")
    cells = in_ranges(cells, variants.select("variant_id"), width)(cells)
    columns = cells.select("block", "sample_id").distinct().withColumn("k", F.row_number().over(Window.partitionBy("block").orderBy("sample_id")))
    columns = written(columns, "vcf-columns")
    heads = columns.groupBy("block").agg(F.transform(F.sort_array(F.collect_list(F.struct("k", "sample_id"))), lambda x: x["sample_id"].cast("string")).alias("names"))
    rows = cells.join(sized(columns), ["block", "sample_id"]).groupBy("block", "variant_id").agg(F.sort_array(F.collect_list(F.struct("k", "t"))).alias("c"))
    none = F.lit(None).cast("array<struct<k:int,t:string>>").alias("c")
    fixed = ["#CHROM", "POS", "ID", "REF", "ALT", "QUAL", "FILTER", "INFO", "FORMAT"]
    first = heads.select("block", F.lit(0).alias("part"), F.lit("##fileformat=VCFv4.2").alias("start"), none, F.lit(0).alias("n"))
    names = heads.select("block", F.lit(1).alias("part"), F.concat_ws("\t", F.lit("\t".join(fixed)), "names").alias("start"), none, F.lit(0).alias("n"))
    info = F.concat(F.lit("MQ="), F.col("mq").cast("string"), F.lit(";VQSLOD="), F.col("vqslod").cast("string"))
    site = F.concat_ws("\t", "chrom", F.col("pos").cast("string"), F.col("variant_id").cast("string"), "ref", "alt", F.lit("."), "filter", info, F.lit("GT:DP:GQ:AF"))
    body = rows.join(variants, "variant_id").join(sized(heads.select("block", F.size("names").alias("n"))), "block").select("block", F.lit(2).alias("part"), site.alias("start"), "c", "n")
    ordered = first.unionByName(names).unionByName(body).repartition("block").sortWithinPartitions("block", "part")
    gap = "repeat('\\t./.', {})"
    fields = f"if(c IS NULL, '', concat(array_join(transform(c, (x, i) -> concat({gap.format('x.k - 1 - if(i = 0, 0, c[i - 1].k)')}, '\\t', x.t)), ''), {gap.format('n - element_at(c, -1).k')}))"
    ordered.select("block", F.concat("start", F.expr(fields)).alias("value")).write.partitionBy("block").option("compression", "gzip").text(path)
    return path
