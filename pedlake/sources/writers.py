"""Writers: genotype formats, result tables in several encodings, relationships and plain SVG plots.

Samples are numbered once in a given order; a variant's calls are then one array in that order, filled by a
position, so no line looks up its samples. Text goes out by Spark, a file per partition in the order of variants;
binary genotypes are written by tasks as parts and joined by a stream copy.
"""

from __future__ import annotations

import html
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pedlake.plans.scratch import Scratch
from pedlake.sources.formats import MAGIC, bim_lines, decode, encode, fam_lines, lgen_lines, number, ped_lines, write_lines
from pedlake.sources.registry import writer


def open_file(path: str, mode: str = "rb"):
    """A file of any file system that a path or URI names, for tasks and the driver alike."""
    system, name = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path.removeprefix("file:"))
    return system.open_input_file(name) if mode == "rb" else system.open_output_stream(name)


def ordered_samples(samples: DataFrame, *keys: str) -> DataFrame:
    """Samples with ``k``, their number from 0 in the order of keys (family and id unless given)."""
    t = Scratch(samples.sparkSession, "order").cut(samples.orderBy(*(keys or ("fid", "iid"))).withColumn("at", F.monotonically_increasing_id()))
    return number(t, "at").withColumnRenamed("n", "k").drop("at")


def dense_rows(calls: DataFrame, order: DataFrame, n: int) -> DataFrame:
    """(vidx, g array<tinyint>) with a place for each of n samples, -1 where there is no call. order: (iid, k)."""
    packed = calls.where("g is not null").join(order.select("iid", "k"), "iid").groupBy("vidx").agg(F.collect_list("k").alias("k"), F.collect_list("g").alias("g"))

    def fill(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            rows = []
            for k, g in zip(pdf["k"], pdf["g"]):
                x = np.full(n, -1, dtype=np.int8)
                x[np.asarray(k)] = np.asarray(g)
                rows.append(x)
            yield pd.DataFrame({"vidx": pdf["vidx"], "g": pd.Series(rows, dtype=object, index=pdf.index)})

    return packed.mapInPandas(fill, "vidx long, g array<tinyint>")


def _with_calls(calls: DataFrame, variants: DataFrame, order: DataFrame, n: int, by: tuple[str, ...] = ("chrom", "pos", "vidx")) -> DataFrame:
    none = F.array_repeat(F.lit(-1).cast("tinyint"), n)
    return variants.join(dense_rows(calls, order, n), "vidx", "left").withColumn("g", F.coalesce("g", none)).orderBy(*by)


def _text(c: str, missing: str) -> Column:
    return F.coalesce(F.col(c).cast("string"), F.lit(missing))


def vcf_file(calls: DataFrame, variants: DataFrame, samples: DataFrame, source: str = "pedlake") -> DataFrame:
    """Lines of a VCF file with its header: version, filters, INFO keys of the variants, and samples in the order of family and id."""
    spark = calls.sparkSession
    order = ordered_samples(samples)
    names = [r["iid"] for r in order.orderBy("k").select("iid").collect()]  # one line of the file holds them all
    filters = sorted(r[0] for r in variants.where("filt is not null and filt not in ('PASS', '.')").select(F.explode(F.split("filt", ";"))).distinct().collect())
    has_info = "info" in variants.columns
    keys = sorted(r[0] for r in variants.select(F.explode(F.map_keys("info"))).distinct().collect()) if has_info else []
    head = ["##fileformat=VCFv4.2", f"##source={source}", *(f'##FILTER=<ID={f},Description="{f}">' for f in filters), *(f'##INFO=<ID={k},Number=.,Type=String,Description="{k}">' for k in keys)]
    head += ['##FORMAT=<ID=GT,Number=1,Type=String,Description="Genotype">', "\t".join(["#CHROM", "POS", "ID", "REF", "ALT", "QUAL", "FILTER", "INFO", "FORMAT", *names])]
    gt = F.array_join(F.transform("g", lambda x: F.when(x < 0, "./.").when(x == 0, "0/0").when(x == 1, "0/1").otherwise("1/1")), "\t")
    info = F.coalesce(F.nullif(F.array_join(F.transform(F.array_sort(F.map_entries("info")), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ";"), F.lit("")), F.lit(".")) if has_info else F.lit(".")
    t = _with_calls(calls, variants, order, len(names))
    body = t.select(F.concat_ws("\t", _text("chrom", "."), _text("pos", "."), _text("id", "."), _text("major", "."), _text("minor", "."), _text("qual", "."), _text("filt", "."), info, F.lit("GT"), gt).alias("line"))
    return spark.createDataFrame([(h,) for h in head], "line string").coalesce(1).unionByName(body)


def gen_lines(calls: DataFrame, variants: DataFrame, samples: DataFrame) -> DataFrame:
    """Variant-major probabilities: id id pos major minor and three numbers a sample, all 0 where missing."""
    order = ordered_samples(samples)
    cells = F.array_join(F.transform("g", lambda x: F.when(x == 0, "1 0 0").when(x == 1, "0 1 0").when(x == 2, "0 0 1").otherwise("0 0 0")), " ")
    t = _with_calls(calls, variants, order, order.count())
    return t.select(F.concat_ws(" ", _text("chrom", "0"), _text("id", "."), _text("pos", "0"), _text("major", "0"), _text("minor", "0"), cells).alias("line"))


def sample_lines(samples: DataFrame) -> DataFrame:
    """The sample file beside ``gen_lines``: two header lines, then ids, missing share, parents, sex and phenotype."""
    spark = samples.sparkSession
    head = spark.createDataFrame([("ID_1 ID_2 missing father mother sex",), ("0 0 0 D D D",)], "line string").coalesce(1)
    body = ordered_samples(samples).orderBy("k").select(F.concat_ws(" ", _text("fid", "0"), "iid", F.lit("0"), _text("pat", "0"), _text("mat", "0"), _text("sex", "0")).alias("line"))
    return head.unionByName(body)


def _alleles(g: Column, missing: str) -> Column:
    a = F.when(g < 0, missing).when(g > 0, F.col("minor")).otherwise(F.col("major"))
    b = F.when(g < 0, missing).when(g > 1, F.col("minor")).otherwise(F.col("major"))
    return F.concat(a, F.lit(" "), b)


def tped_lines(calls: DataFrame, variants: DataFrame, samples: DataFrame) -> DataFrame:
    """CHR ID CM POS and two alleles a sample."""
    order = ordered_samples(samples)
    t = _with_calls(calls, variants, order, order.count())
    gdist = _text("gdist", "0") if "gdist" in variants.columns else F.lit("0")
    return t.select(F.concat_ws(" ", _text("chrom", "0"), _text("id", "."), gdist, _text("pos", "0"), F.array_join(F.transform("g", lambda x: _alleles(x, "0")), " ")).alias("line"))


def beagle_lines(calls: DataFrame, variants: DataFrame, samples: DataFrame) -> DataFrame:
    """A line of ids (each twice), then a marker a line with two alleles a sample."""
    order = ordered_samples(samples)
    names = [r["iid"] for r in order.orderBy("k").select("iid").collect()]  # one line of the file holds them all
    head = calls.sparkSession.createDataFrame([(" ".join(["I", "id", *(f"{n} {n}" for n in names)]),)], "line string").coalesce(1)
    return head.unionByName(_with_calls(calls, variants, order, len(names)).select(F.concat_ws(" ", F.lit("M"), _text("id", "."), F.array_join(F.transform("g", lambda x: _alleles(x, "?")), " ")).alias("line")))


def merlin_files(calls: DataFrame, variants: DataFrame, samples: DataFrame) -> dict[str, DataFrame]:
    """ped, dat and map lines: a pedigree with alleles a/b, the order of its columns, and positions."""
    v = variants.orderBy("chrom", "pos", "vidx")
    cm = F.coalesce("gdist", F.col("pos") / 1e6) if "gdist" in variants.columns else F.col("pos") / 1e6
    return {"ped": ped_lines(calls, variants, samples), "dat": v.select(F.concat(F.lit("M "), "id").alias("line")), "map": v.select(F.concat_ws(" ", _text("chrom", "0"), "id", F.round(cm, 6)).alias("line"))}


def raw_lines(calls: DataFrame, variants: DataFrame, samples: DataFrame, coding: str = "additive") -> DataFrame:
    """A sample a line: FID IID PAT MAT SEX and a number a variant, NA where missing: additive 0/1/2, dominant, recessive, or mdr (cells 0 to
    2, -1 missing)."""
    order = variants.orderBy("vidx").select("vidx", "id")
    names = [r["id"] for r in order.collect()]  # one line of the file holds them all
    place = number(Scratch(calls.sparkSession, "raw").cut(order.withColumn("at", F.monotonically_increasing_id())), "at").select("vidx", F.col("n").alias("k"))
    code = {"additive": F.col("g"), "dominant": (F.col("g") > 0).cast("tinyint"), "recessive": (F.col("g") == 2).cast("tinyint"), "mdr": F.col("g")}[coding]
    cells = calls.where("g is not null").join(place, "vidx").groupBy("iid").agg(F.collect_list("k").alias("k"), F.collect_list(code.cast("tinyint")).alias("g"))
    n, gap = len(names), "-1" if coding == "mdr" else "NA"

    def fill(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            out = []
            for k, g in zip(pdf["k"], pdf["g"]):
                x = np.full(n, gap, dtype=object)
                x[np.asarray(k)] = np.asarray(g).astype(str)
                out.append(" ".join(x))
            yield pd.DataFrame({"iid": pdf["iid"], "cells": out})

    t = samples.join(cells.mapInPandas(fill, "iid string, cells string"), "iid", "left")
    body = t.orderBy("fid", "iid").select(F.concat_ws(" ", _text("fid", "0"), "iid", _text("pat", "0"), _text("mat", "0"), _text("sex", "0"), F.coalesce("cells", F.lit(" ".join([gap] * n)))).alias("line"))
    head = calls.sparkSession.createDataFrame([(" ".join(["FID", "IID", "PAT", "MAT", "SEX", *names]),)], "line string").coalesce(1)
    return head.unionByName(body)


def write_bed(calls: DataFrame, variants: DataFrame, samples: DataFrame, path: str, sample_major: bool = False) -> None:
    """path.bed, path.bim and path.fam. Tasks write encoded parts, which are then copied one after the other."""
    spark = calls.sparkSession
    order = ordered_samples(samples)
    n = order.count()
    v = number(Scratch(spark, "bed").cut(variants.orderBy("chrom", "pos", "vidx").withColumn("at", F.monotonically_increasing_id())), "at").withColumnRenamed("n", "row")
    if sample_major:
        width, packed = v.count(), calls.where("g is not null").join(v.select("vidx", "row"), "vidx").join(order.select("iid", "k"), "iid").groupBy(F.col("k").alias("line")).agg(F.collect_list("row").alias("k"), F.collect_list("g").alias("g"))
        lines = order.select(F.col("k").alias("line")).join(packed, "line", "left")
    else:
        width, packed = n, calls.where("g is not null").join(order.select("iid", "k"), "iid").groupBy("vidx").agg(F.collect_list("k").alias("k"), F.collect_list("g").alias("g"))
        lines = v.select("vidx", F.col("row").alias("line")).join(packed, "vidx", "left").select("line", "k", "g")
    parts = f"{path}.bed.parts"

    def put(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        blocks, first = [], None
        for pdf in it:
            x = np.full((len(pdf), width), -1, dtype=np.int8)
            for i, (k, g) in enumerate(zip(pdf["k"], pdf["g"])):
                if k is not None:
                    x[i, np.asarray(k)] = np.asarray(g)
            first = int(pdf["line"].iloc[0]) if first is None and len(pdf) else first
            blocks.append(encode(x) if width else b"")
        if first is not None:
            with open_file(f"{parts}/{first:020d}", "wb") as f:
                for b in blocks:
                    f.write(b)
            yield pd.DataFrame({"first": [first]})

    system, name = fs.FileSystem.from_uri(parts) if "://" in parts else (fs.LocalFileSystem(), parts)
    system.create_dir(name, recursive=True)
    firsts = sorted(r["first"] for r in lines.orderBy("line").mapInPandas(put, "first long").collect())  # a row per task
    with open_file(f"{path}.bed", "wb") as out:
        out.write(MAGIC[:2] + (b"\x00" if sample_major else MAGIC[2:]))
        for k in firsts:
            with open_file(f"{parts}/{k:020d}") as f:
                while block := f.read(1 << 24):
                    out.write(block)
    system.delete_dir(name)
    for lines_, suffix in ((bim_lines(v.drop("vidx").withColumnRenamed("row", "vidx") if "gdist" in v.columns else v.drop("vidx").withColumnRenamed("row", "vidx").withColumn("gdist", F.lit(0))), "bim"), (fam_lines(order.orderBy("k") if "pheno" in order.columns else order.withColumn("pheno", F.lit(None).cast("double")).orderBy("k")), "fam")):
        with open_file(f"{path}.{suffix}", "wb") as f:
            for r in lines_.toLocalIterator():
                f.write((r["line"] + "\n").encode())


def read_bed(spark: SparkSession, path: str, n_samples: int, n_variants: int | None = None, block: int = 4096) -> DataFrame:
    """(vidx, g array<tinyint>), null missing, of a binary genotype file on any file system. A sample-major file gives (sample_no, g) in
    the order of variants; it needs n_variants."""
    with open_file(path) as f:
        head, size = f.read(3), f.size()
    if head[:2] != MAGIC[:2] or head[2] not in (0, 1):
        raise ValueError("not a binary genotype file")
    major = head[2] == 1
    if not major and n_variants is None:
        raise ValueError("a sample-major file needs the number of variants")
    per = n_samples if major else n_variants
    width = -(-per // 4)
    total = (size - 3) // width
    key = "vidx" if major else "sample_no"

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        with open_file(path) as f:
            for pdf in it:
                for a in pdf["id"]:
                    n = min(block, total - a)
                    f.seek(3 + a * width)
                    g = decode(f.read(n * width), per).astype(object)
                    g[g == -1] = None
                    yield pd.DataFrame({key: np.arange(a, a + n), "g": pd.Series(list(g), dtype=object)})

    parts = spark.range(0, total, block, numPartitions=max(1, min(-(-total // block), 10_000)))
    return parts.mapInPandas(run, f"{key} long, g array<tinyint>")


def _bgen_variant(v, g: np.ndarray) -> bytes:
    """A variant of a BGEN file (layout 2, zlib, 8 bits): fixed fields of the format."""
    text = lambda x, size: len(x := str(x).encode()).to_bytes(size, "little") + x
    n = len(g)
    head = text(v.id, 2) + text(v.id, 2) + text(v.chrom, 2) + int(v.pos).to_bytes(4, "little") + (2).to_bytes(2, "little") + text(v.major, 4) + text(v.minor, 4)
    ploidy = np.where(g < 0, 0x82, 2).astype(np.uint8).tobytes()
    prob = np.array([[255, 0], [0, 255], [0, 0], [0, 0]], dtype=np.uint8)[np.where(g < 0, 3, g)].tobytes()
    data = n.to_bytes(4, "little") + (2).to_bytes(2, "little") + b"\x02\x02" + ploidy + b"\x00\x08" + prob
    packed = zlib.compress(data)
    return head + (len(packed) + 4).to_bytes(4, "little") + len(data).to_bytes(4, "little") + packed


def write_bgen(calls: DataFrame, variants: DataFrame, samples: DataFrame, path: str) -> None:
    """A BGEN file with its sample ids: probabilities 0 or 1 of hard calls, missing samples marked. Tasks write parts, copied in order."""
    spark = calls.sparkSession
    order = ordered_samples(samples)
    names = [r["iid"].encode() for r in order.orderBy("k").select("iid").collect()]  # the header holds them all
    n = len(names)
    t = Scratch(spark, "bgen").cut(_with_calls(calls, variants.where("pos is not null"), order, n).select("vidx", F.coalesce("id", F.lit(".")).alias("id"), F.coalesce(F.col("chrom").cast("string"), F.lit("0")).alias("chrom"), "pos", F.coalesce("major", F.lit("N")).alias("major"), F.coalesce("minor", F.lit("N")).alias("minor"), "g").withColumn("at", F.monotonically_increasing_id()))
    rows = number(t, "at").withColumnRenamed("n", "line")
    parts = f"{path}.parts"
    system, name = fs.FileSystem.from_uri(parts) if "://" in parts else (fs.LocalFileSystem(), parts)
    system.create_dir(name, recursive=True)

    def put(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        first, out = None, []
        for pdf in it:
            first = int(pdf["line"].iloc[0]) if first is None and len(pdf) else first
            out += [_bgen_variant(v, np.asarray(v.g)) for v in pdf.itertuples(index=False)]
        if first is not None:
            with open_file(f"{parts}/{first:020d}", "wb") as f:
                for b in out:
                    f.write(b)
            yield pd.DataFrame({"first": [first], "n": [len(out)]})

    done = sorted((r["first"], r["n"]) for r in rows.orderBy("line").mapInPandas(put, "first long, n long").collect())  # a row per task
    ids = n.to_bytes(4, "little") + b"".join(len(x).to_bytes(2, "little") + x for x in names)
    ids = (len(ids) + 4).to_bytes(4, "little") + ids
    flags = 1 | 2 << 2 | 1 << 31  # zlib, layout 2, sample ids
    head = (20).to_bytes(4, "little") + sum(k for _, k in done).to_bytes(4, "little") + n.to_bytes(4, "little") + b"bgen" + flags.to_bytes(4, "little")
    with open_file(path, "wb") as out:
        out.write((len(head) + len(ids)).to_bytes(4, "little") + head + ids)
        for k, _ in done:
            with open_file(f"{parts}/{k:020d}") as f:
                while block := f.read(1 << 24):
                    out.write(block)
    system.delete_dir(name)


def write_by_gene(calls: DataFrame, variants: DataFrame, samples: DataFrame, sets: DataFrame, path: str) -> None:
    """Long rows of genotypes with a folder per gene."""
    t = calls.join(sets, "vidx").select("gene", "vidx", "iid", "g")
    t.join(variants.select("vidx", "id", "major", "minor"), "vidx").join(samples.select("iid", "fid"), "iid").write.mode("overwrite").partitionBy("gene").parquet(path)


# Results
def result_lines(df: DataFrame, form: str = "tab", missing: str = "NA") -> DataFrame:
    """Lines of a table: ``tab``, ``csv`` or ``space`` with a header, ``json`` an object a line, ``xml`` an element a line in one root."""
    spark = df.sparkSession
    if form == "json":
        return df.select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("line"))
    if form == "xml":
        esc = lambda c: F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
        cells = [F.when(F.col(c).isNotNull(), F.concat(F.lit(f"<{c}>"), esc(F.col(c).cast("string")), F.lit(f"</{c}>"))) for c in df.columns]
        one = lambda s: spark.createDataFrame([(s,)], "line string").coalesce(1)
        return one("<table>").unionByName(df.select(F.concat(F.lit("<row>"), F.concat_ws("", *cells), F.lit("</row>")).alias("line"))).unionByName(one("</table>"))
    sep = {"tab": "\t", "csv": ",", "space": " "}[form]
    quoted = lambda c: F.when(c.rlike('[",\n]'), F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(c) if form == "csv" else c
    head = spark.createDataFrame([(sep.join(df.columns),)], "line string").coalesce(1)
    return head.unionByName(df.select(F.concat_ws(sep, *(quoted(_text(c, missing)) for c in df.columns)).alias("line")))


def relationship_lines(pairs: DataFrame, form: str = "pair", value: str = "value") -> DataFrame:
    """Lines of (iid1, iid2, value[, n]): ``pair``, ``gcta`` (numbers of samples, shared variants, value), ``epacts`` and ``rvtests`` (ids with a
    header), ``matrix`` (a row a sample, its partners in the order of ids)."""
    if form == "pair":
        return pairs.select(F.concat_ws("\t", "iid1", "iid2", value).alias("line"))
    if form in ("epacts", "rvtests"):
        head = pairs.sparkSession.createDataFrame([("#IND1\tIND2\tKINSHIP",) if form == "epacts" else ("IID1\tIID2\tIBD",)], "line string").coalesce(1)
        return head.unionByName(pairs.select(F.concat_ws("\t", "iid1", "iid2", F.col(value) / 2 if form == "epacts" else F.col(value)).alias("line")))
    every = pairs.select(F.col("iid1").alias("iid")).unionByName(pairs.select(F.col("iid2").alias("iid"))).distinct().withColumn("fid", F.lit(""))
    order = ordered_samples(every).select("iid", "k")
    t = pairs.join(order.withColumnsRenamed({"iid": "iid1", "k": "a"}), "iid1").join(order.withColumnsRenamed({"iid": "iid2", "k": "b"}), "iid2")
    if form == "gcta":
        n = F.col("n") if "n" in pairs.columns else F.lit(0)
        return t.select(F.concat_ws("\t", F.greatest("a", "b") + 1, F.least("a", "b") + 1, n, value).alias("line"))
    both = t.select("a", "b", value).unionByName(t.select(F.col("b").alias("a"), F.col("a").alias("b"), value)).distinct()
    row = both.groupBy("a").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("b", F.col(value).cast("string").alias("x")))), lambda s: F.concat(s["b"].cast("string"), F.lit(":"), s["x"])), " ").alias("x"))
    return row.join(order, F.col("a") == F.col("k")).orderBy("a").select(F.concat_ws(" ", "iid", "x").alias("line"))


# Plots, drawn by the driver from binned rows
def _svg(width: int, height: int, body: list[str], title: str) -> str:
    return f'<svg xmlns="http://www.w3.org/2000/svg" width="{width}" height="{height}"><title>{html.escape(title)}</title>' + "".join(body) + "</svg>"


def histogram_svg(df: DataFrame, column: str, bins: int = 40) -> str:
    """Bars of a column's counts by bin."""
    lo, hi = df.agg(F.min(column), F.max(column)).first()
    if lo is None:
        return _svg(600, 300, [], column)
    step = (hi - lo) / bins or 1.0
    at = F.least(F.floor((F.col(column) - F.lit(lo)) / F.lit(step)), F.lit(bins - 1)).cast("int")
    n = {r["b"]: r["n"] for r in df.where(F.col(column).isNotNull()).groupBy(at.alias("b")).agg(F.count(F.lit(1)).alias("n")).collect()}
    top = max(n.values())
    return _svg(600, 300, [f'<rect x="{600 * b / bins:.1f}" y="{290 - 280 * k / top:.1f}" width="{600 / bins - 1:.1f}" height="{280 * k / top:.1f}"/>' for b, k in sorted(n.items())], column)


def qq_svg(df: DataFrame, p: str = "p", points: int = 1000) -> str:
    """Observed against expected -log10 p at ``points`` quantiles, taken in one pass."""
    grid = [1 - (i + 0.5) / points for i in range(points)]
    row = df.where(F.col(p).isNotNull()).agg(F.count(F.lit(1)).alias("n"), F.percentile_approx(-F.log10(F.greatest(F.col(p), F.lit(1e-300))), grid, 100_000).alias("q")).first()
    seen = row["q"] or []
    expect = [-np.log10(1 - g) for g in grid] if seen else []
    top = max([1.0, *expect, *seen])
    dots = [f'<circle cx="{10 + 380 * e / top:.1f}" cy="{390 - 380 * o / top:.1f}" r="2"/>' for e, o in zip(expect, seen)]
    return _svg(400, 400, [f'<line x1="10" y1="390" x2="390" y2="10" stroke="grey"/>', *dots], f"{row['n']} tests")


def manhattan_svg(df: DataFrame, p: str = "p", width: int = 1000) -> str:
    """The least p in each pixel of (chromosome, position). df: (chrom, pos, p)."""
    t = df.where(F.col(p).isNotNull() & F.col("chrom").isNotNull() & F.col("pos").isNotNull())
    ends = {r["chrom"]: r["m"] for r in t.groupBy("chrom").agg(F.max("pos").alias("m")).collect()}
    whole = sum(ends.values()) or 1
    start, run = {}, 0
    for k in sorted(ends):
        start[k], run = run, run + ends[k]
    at = F.lit(0)
    for k, s in start.items():
        at = F.when(F.col("chrom") == k, F.floor((F.col("pos") + s) * F.lit(width - 1) / whole)).otherwise(at)
    dots = t.groupBy("chrom", at.alias("x")).agg(F.max(-F.log10(F.greatest(F.col(p), F.lit(1e-300)))).alias("y")).collect()  # at most a row per pixel and chromosome
    top = max([1.0, *(r["y"] for r in dots)])
    return _svg(width, 300, [f'<circle cx="{r["x"]}" cy="{290 - 280 * r["y"] / top:.1f}" r="2" fill="{"navy" if r["chrom"] % 2 else "teal"}"/>' for r in dots], "association")


def pedigree_svg(family: list[tuple[str, str | None, str | None, int]]) -> str:
    """One family (iid, pat, mat, sex) by generation: squares, circles, and lines from the middle of a couple to its children."""
    depth: dict[str, int] = {}
    up = {i: [x for x in (a, b) if x] for i, a, b, _ in family}
    for _ in range(len(up) + 1):
        for i, ps in up.items():
            depth[i] = max((depth.get(p, 0) + 1 for p in ps if p in up), default=0)
    rows: dict[int, list[str]] = {}
    for i in sorted(up, key=lambda i: (depth[i], str(up[i]), i)):
        rows.setdefault(depth[i], []).append(i)
    wide = max(map(len, rows.values()), default=1)
    place = {i: (30 + 60 * (n + (wide - len(r)) / 2), 30 + 80 * d) for d, r in rows.items() for n, i in enumerate(r)}
    body = []
    for i, _, _, sex in family:
        x, y = place[i]
        body.append(f'<rect x="{x - 12}" y="{y - 12}" width="24" height="24" fill="none" stroke="black"/>' if sex == 1 else f'<circle cx="{x}" cy="{y}" r="12" fill="none" stroke="black"/>')
        body.append(f'<text x="{x}" y="{y + 26}" font-size="9" text-anchor="middle">{html.escape(i)}</text>')
        ends = [place[p] for p in up[i] if p in place]
        if ends:
            mx, my = sum(e[0] for e in ends) / len(ends), max(e[1] for e in ends)
            body.append(f'<line x1="{mx}" y1="{my + 12}" x2="{x}" y2="{y - 12}" stroke="black"/>')
    return _svg(60 * wide + 20, 80 * max(1, len(rows)) + 30, body, "family")


@writer("bed")
def _bed(tables, path, **options):
    write_bed(tables.calls, tables.variants, tables.samples, path, **options)


@writer("bgen")
def _bgen(tables, path, **options):
    write_bgen(tables.calls, tables.variants, tables.samples, path)


def _lines_writer(name, make):
    @writer(name)
    def put(tables, path, compression=None, **options):
        write_lines(make(tables.calls, tables.variants, tables.samples, **options), path, compression)


for _name, _make in {"vcf": vcf_file, "gen": gen_lines, "tped": tped_lines, "beagle": beagle_lines, "raw": raw_lines, "lgen": lambda c, v, s: lgen_lines(c, v, s), "ped": ped_lines}.items():
    _lines_writer(_name, _make)


@writer("table")
def _table(df, path, form="tab", compression=None):
    write_lines(result_lines(df, form), path, compression)
