"""Text and binary formats of genotypes: readers to cohort tables, and writers.

Text is read by ``spark.read.text`` (gzip and bgzip by Spark's codecs, several files by glob) and taken apart with
built-in functions. Binary genotype files are read in blocks of whole variants by byte ranges, so a file
of any size is spread over tasks.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

WHITE = r"[ \t]+"


def _lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    line = F.btrim(F.col("value"), F.lit(" \t\r"))
    return spark.read.text(path).select(line.alias("line"), "_metadata.file_path").where("line != ''")


def _field(i: int, sep: str = WHITE, col: str = "line") -> Column:
    return F.get(F.split(col, sep), F.lit(i))


def chromosome(c: Column) -> Column:
    """1..22, X 23, Y 24, XY 25, MT 26, null otherwise; a leading ``chr`` doesn't count."""
    s = F.upper(F.regexp_replace(c, r"(?i)^chr", ""))
    return F.when(s == "X", 23).when(s == "Y", 24).when(s == "XY", 25).when(s.isin("M", "MT"), 26).otherwise(s.try_cast("int"))


def read_fam(spark: SparkSession, path: str, parent_missing: str = "0") -> DataFrame:
    """FID IID PAT MAT SEX [PHENO]; phenotype -9 and non-numbers are null."""
    f = [_field(i) for i in range(6)]
    no = lambda c: F.nullif(c, F.lit(parent_missing))
    ph = f[5].try_cast("double")
    out = _lines(spark, path).select(f[0].alias("fid"), f[1].alias("iid"), no(f[2]).alias("pat"), no(f[3]).alias("mat"), F.when(f[4].isin("1", "2"), f[4]).cast("tinyint").alias("sex"), F.when(ph != -9, ph).alias("pheno"))
    return out.withColumn("founder", F.col("pat").isNull() & F.col("mat").isNull())


def with_missing_founders(samples: DataFrame) -> DataFrame:
    """Adds named parents that have no row of their own, as founders of the family."""
    named = samples.select("fid", F.col("pat").alias("iid"), F.lit(1).alias("s")).unionByName(samples.select("fid", F.col("mat").alias("iid"), F.lit(2).alias("s"))).where("iid is not null")
    new = named.groupBy("fid", "iid").agg(F.min("s").cast("tinyint").alias("sex")).join(samples.select("fid", "iid"), ["fid", "iid"], "left_anti")
    return samples.unionByName(new.withColumn("founder", F.lit(True)), allowMissingColumns=True)


def read_bim(spark: SparkSession, path: str) -> DataFrame:
    """Variants of a BIM (6 columns) or MAP (4 or 3 columns) file, numbered in the order of lines."""
    lines = _lines(spark, path).withColumn("f", F.split("line", WHITE))
    n, at = F.size("f"), lambda i: F.get("f", F.lit(i))
    four = n >= 4
    v = lines.select(F.monotonically_increasing_id().alias("at"), chromosome(at(0)).alias("chrom"), at(1).alias("id"), F.when(four, at(2)).try_cast("double").alias("gdist"), F.when(four, at(3)).otherwise(at(2)).try_cast("int").alias("pos"), at(4).alias("minor"), at(5).alias("major"))
    return number(v, "at").withColumnRenamed("n", "vidx").drop("at")


def number(df: DataFrame, order: str) -> DataFrame:
    """0, 1, 2, ... in the order of monotonically increasing ids: counts per partition, then an offset."""
    part = F.shiftright(F.col(order), 33)
    rows = df.withColumn("part_", part)
    counts = sorted((r["part_"], r["n"]) for r in rows.groupBy("part_").agg(F.count(F.lit(1)).alias("n")).collect())  # a row per partition
    start, run = [], 0
    for k, n in counts:
        start.append((k, run))
        run += n
    offsets = F.create_map(*(F.lit(x) for kv in start for x in kv)) if start else None
    base = F.element_at(offsets, F.col("part_")) if start else F.lit(0)
    return rows.withColumn("n", base.cast("long") + F.col(order).bitwiseAND(F.lit((1 << 33) - 1))).drop("part_")


def read_vcf(spark: SparkSession, path: str | list[str], field: str = "GT", phase: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(variants, calls), both with vidx, the number of the site in the order of files and lines. Sites with more than
    two ALT alleles are left out; those with two only if no called allele is the reference, and then the second ALT
    counts. ID ``.`` becomes chr:pos, ids may repeat; of a repeated INFO key the last value counts. g counts ALT
    alleles, null if any allele is missing; ``field="DS"`` gives dosages d instead. ``phase`` keeps the genotypes
    written with | ("phased") or / ("unphased") and makes others missing. Sample names come from the header."""
    lines = spark.read.text(path).select(F.col("value").alias("line"), "_metadata.file_path")
    head = lines.where(F.startswith("line", F.lit("#CHROM"))).select("file_path", F.slice(F.split(F.btrim("line", F.lit("\r")), "\t"), 10, 1 << 30).alias("names"))
    c = F.split(F.btrim("line", F.lit("\r")), "\t")
    at = lambda i: F.get(c, F.lit(i))
    rows = lines.where(~F.startswith("line", F.lit("#")) & (F.size(c) >= 8)).select("file_path", F.monotonically_increasing_id().alias("at"), at(0).alias("chr"), at(1).try_cast("int").alias("pos"), at(2).alias("name"), at(3).alias("ref"), F.split(at(4), ",").alias("alt"), at(5).try_cast("double").alias("qual"), at(6).alias("filt"), at(7).alias("info"), F.split(at(8), ":").alias("fmt"), F.slice(c, 10, 1 << 30).alias("cells"))
    rows = number(rows, "at").withColumnRenamed("n", "vidx").drop("at")
    k = F.array_position("fmt", field).cast("int")
    raw = F.transform("cells", lambda x: F.get(F.split(x, ":"), k - 1))
    rows = rows.where(F.size("alt") <= 2).withColumn("raw", F.when(k > 0, raw))
    if field == "GT":
        alleles = F.transform("raw", lambda x: F.split(x, r"[/|]"))
        if phase:
            mark = {"phased": "|", "unphased": "/"}[phase]
            alleles = F.transform("raw", lambda x: F.when(F.contains(x, F.lit(mark)), F.split(x, r"[/|]")).otherwise(F.array(F.lit("."))))
        reference = F.exists(alleles, lambda a: F.array_contains(a, "0"))
        rows = rows.withColumn("a", alleles).where((F.size("alt") == 1) | ~F.coalesce(reference, F.lit(False)))
    pairs = F.transform(F.split("info", ";"), lambda e: F.struct(F.get(F.split(e, "="), F.lit(0)).alias("k"), F.coalesce(F.get(F.split(e, "=", 2), F.lit(1)), F.lit("1")).alias("v")))
    last = F.filter(F.col("pairs"), lambda p, i: ~F.exists(F.slice("pairs", i + 2, F.size("pairs")), lambda q: q["k"] == p["k"]))
    name = F.when(F.col("name") == ".", F.concat_ws(":", "chr", "pos")).otherwise(F.col("name"))
    variants = rows.withColumn("pairs", pairs).select("vidx", chromosome(F.col("chr")).alias("chrom"), name.alias("id"), "pos", F.when(F.size("alt") == 1, F.col("ref")).otherwise(F.get("alt", F.lit(0))).alias("major"), F.element_at("alt", -1).alias("minor"), "qual", "filt", F.map_from_entries(last).alias("info"))
    long = rows.join(head, "file_path").select("vidx", name.alias("id"), "names", F.size("alt").alias("n_alt"), F.posexplode("a" if field == "GT" else "raw").alias("i", "x"))
    iid = F.get("names", F.col("i")).alias("iid")
    if field != "GT":
        return variants, long.select("vidx", "id", iid, F.col("x").try_cast("double").alias("d"))
    known = ~F.exists("x", lambda a: ~a.rlike(r"^[0-9]+$"))
    g = F.when(known & (F.size("x") <= 2), F.size(F.filter("x", lambda a: a == F.col("n_alt").cast("string"))))
    return variants, long.select("vidx", "id", iid, g.cast("tinyint").alias("g"))


def read_lgen(spark: SparkSession, path: str, minor: DataFrame) -> DataFrame:
    """Long rows FID IID VARIANT A1 A2; minor (id, minor) tells the counted allele, ``0`` is missing."""
    f = [_field(i) for i in range(5)]
    t = _lines(spark, path).select(f[0].alias("fid"), f[1].alias("iid"), f[2].alias("id"), f[3].alias("a"), f[4].alias("b"))
    hit = lambda x: (F.col(x) == F.col("minor")).cast("int")
    return t.join(minor, "id").select("fid", "iid", "id", F.when((F.col("a") != "0") & (F.col("b") != "0"), hit("a") + hit("b")).cast("tinyint").alias("g"))


def _count_minor(cells: DataFrame) -> DataFrame:
    """(keys, vidx, a, b) to g: the rarer allele of a variant is counted, of equal ones the greater."""
    alleles = cells.select("vidx", F.explode(F.array("a", "b")).alias("x")).where("x != '0'").groupBy("vidx", "x").agg(F.count(F.lit(1)).alias("n"))
    minor = alleles.groupBy("vidx").agg(F.min_by("x", F.struct("n", F.negative(F.ascii("x")))).alias("minor"), F.count(F.lit(1)).alias("k"))
    hit = lambda x: (F.col(x) == F.col("minor")).cast("int")
    g = F.when((F.col("a") != "0") & (F.col("b") != "0"), F.when(F.col("k") == 1, 0).otherwise(hit("a") + hit("b")))
    return cells.join(minor, "vidx").withColumn("g", g.cast("tinyint")).drop("a", "b", "minor", "k")


def read_ped(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(samples, calls): FAM columns and two alleles per variant on each line."""
    t = _lines(spark, path).withColumn("f", F.split("line", WHITE))
    at = lambda i: F.get("f", F.lit(i))
    samples = t.select(at(0).alias("fid"), at(1).alias("iid"), F.nullif(at(2), F.lit("0")).alias("pat"), F.nullif(at(3), F.lit("0")).alias("mat"), at(4).try_cast("tinyint").alias("sex"), at(5).try_cast("double").alias("pheno"))
    n = F.floor((F.size("f") - 6) / 2).cast("int")
    pairs = F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.struct(F.get("f", 6 + 2 * i).alias("a"), F.get("f", 7 + 2 * i).alias("b"))))
    cells = t.select(at(0).alias("fid"), at(1).alias("iid"), F.posexplode(pairs).alias("vidx", "p")).select("fid", "iid", F.col("vidx").cast("long").alias("vidx"), "p.a", "p.b")
    return samples, _count_minor(cells)


def read_tped(spark: SparkSession, path: str) -> DataFrame:
    """Variant-major text: CHR ID CM POS, then two alleles per sample; ``sample_no`` is the place in the FAM file."""
    t = _lines(spark, path).withColumn("f", F.split("line", WHITE)).withColumn("at", F.monotonically_increasing_id())
    t = number(t, "at").withColumnRenamed("n", "vidx")
    n = F.floor((F.size("f") - 4) / 2).cast("int")
    pairs = F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.struct(F.get("f", 4 + 2 * i).alias("a"), F.get("f", 5 + 2 * i).alias("b"))))
    return _count_minor(t.select("vidx", F.posexplode(pairs).alias("sample_no", "p")).select("vidx", "sample_no", "p.a", "p.b"))


def read_dosage(spark: SparkSession, path: str, samples: list[str], lead: int = 3, triplets: bool = False) -> DataFrame:
    """Dosages of one line per variant: ``lead`` columns (the first is the id), then a number per sample, or
    three genotype probabilities (d = p1 + 2 p2)."""
    t = _lines(spark, path).withColumn("f", F.split("line", WHITE))
    k = 3 if triplets else 1
    x = lambda i: F.get("f", i).try_cast("double")
    d = F.transform(F.sequence(F.lit(0), F.lit(len(samples) - 1)), lambda i: x(lead + k * i + 1) + 2 * x(lead + k * i + 2) if triplets else x(lead + i))
    return t.select(F.get("f", F.lit(0)).alias("id"), F.posexplode(d).alias("i", "d")).select("id", F.get(F.array(*map(F.lit, samples)), F.col("i")).alias("iid"), "d")


def read_traits(spark: SparkSession, path: str, missing: float = -9.0) -> DataFrame:
    """Long traits of a table with header FID IID NAME...; a trait with only the values 1, 2 (or 0, 1) is binary."""
    lines = _lines(spark, path)
    header = lines.where(F.upper("line").rlike(r"^#?FID[ \t]")).select("line").first()
    names = header["line"].split()[2:] if header else []
    t = lines.where(~F.upper("line").rlike(r"^#?FID[ \t]"))
    v = F.transform(F.slice(F.split("line", WHITE), 3, max(1, len(names))), lambda s: s.try_cast("double"))
    long = t.select(_field(0).alias("fid"), _field(1).alias("iid"), F.posexplode(v).alias("i", "x")).select("fid", "iid", F.get(F.array(*map(F.lit, names)) if names else F.array().cast("array<string>"), F.col("i")).alias("trait"), F.when(F.col("x") != missing, F.col("x")).alias("val"))
    kind = long.groupBy("trait").agg(F.when(F.bool_and(F.coalesce(F.col("val").isin(0.0, 1.0, 2.0), F.lit(True))), "binary").otherwise("continuous").alias("kind"))
    return long.join(kind, "trait")


# Binary genotypes: fixed values of the format.
MAGIC = b"\x6c\x1b\x01"
_G = np.array([2, -1, 1, 0], dtype=np.int8)  # codes 00, 01, 10, 11 of two bits


def decode(block: bytes, n_samples: int) -> np.ndarray:
    """Variants x samples of 0, 1, 2, or -1 for missing."""
    width = -(-n_samples // 4)
    raw = np.frombuffer(block, dtype=np.uint8).reshape(-1, width)
    codes = (raw[:, :, None] >> np.array([0, 2, 4, 6], dtype=np.uint8)) & 3
    return _G[codes.reshape(len(raw), -1)[:, :n_samples]]


def encode(g: np.ndarray) -> bytes:
    code = np.array([3, 2, 0, 1], dtype=np.uint8)[np.where(g < 0, 3, g)]
    pad = np.zeros((len(g), -g.shape[1] % 4), dtype=np.uint8)
    c = np.hstack([code, pad]).reshape(len(g), -1, 4)
    return (c << np.array([0, 2, 4, 6], dtype=np.uint8)).sum(2).astype(np.uint8).tobytes()


def read_bed(spark: SparkSession, path: str, n_samples: int, block: int = 4096) -> DataFrame:
    """(vidx, g array<tinyint>) of a variant-major file; null is missing. See ``writers.read_bed``."""
    from pedlake.sources import writers

    return writers.read_bed(spark, path, n_samples, block=block)


# Writers: lines in the order of the first column of the cohort tables.
def write_lines(df: DataFrame, path: str, compression: str | None = None) -> None:
    df.write.mode("overwrite").option("compression", compression or "none").text(path)


def fam_lines(samples: DataFrame) -> DataFrame:
    cols = ["fid", "iid", F.coalesce("pat", F.lit("0")), F.coalesce("mat", F.lit("0")), F.coalesce(F.col("sex").cast("string"), F.lit("0")), F.coalesce(F.col("pheno").cast("string"), F.lit("-9"))]
    return samples.select(F.concat_ws("\t", *cols).alias("line"))


def bim_lines(variants: DataFrame) -> DataFrame:
    return variants.orderBy("vidx").select(F.concat_ws("\t", F.coalesce("chrom", F.lit(0)), "id", F.coalesce("gdist", F.lit(0)), F.coalesce("pos", F.lit(0)), F.coalesce("minor", F.lit("0")), F.coalesce("major", F.lit("0"))).alias("line"))


def lgen_lines(calls: DataFrame, variants: DataFrame, samples: DataFrame) -> DataFrame:
    """FID IID VARIANT A1 A2."""
    t = calls.join(variants.select("vidx", "id", "major", "minor"), "vidx").join(samples.select("iid", "fid"), "iid")
    a = F.when(F.col("g").isNull(), "0").when(F.col("g") > 0, F.col("minor")).otherwise(F.col("major"))
    b = F.when(F.col("g").isNull(), "0").when(F.col("g") > 1, F.col("minor")).otherwise(F.col("major"))
    return t.select(F.concat_ws("\t", "fid", "iid", "id", a, b).alias("line"))


def vcf_lines(calls: DataFrame, variants: DataFrame, samples: list[str]) -> DataFrame:
    """Data lines of a VCF file for a given order of samples; absent calls are missing. ``writers.vcf_file`` has a header."""
    from pedlake.sources import writers

    order = calls.sparkSession.createDataFrame(list(enumerate(samples)), "k long, iid string")
    cells = F.array_join(F.transform("g", lambda x: F.when(x < 0, "./.").when(x == 0, "0/0").when(x == 1, "0/1").otherwise("1/1")), "\t")
    dot = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("."))
    t = variants.join(writers.dense_rows(calls, order, len(samples)), "vidx", "left").withColumn("g", F.coalesce("g", F.array_repeat(F.lit(-1).cast("tinyint"), len(samples)))).orderBy("chrom", "pos", "vidx")
    return t.select(F.concat_ws("\t", dot("chrom"), dot("pos"), dot("id"), dot("major"), dot("minor"), dot("qual"), dot("filt"), F.lit("."), F.lit("GT"), cells).alias("line"))


def ped_lines(calls: DataFrame, variants: DataFrame, samples: DataFrame) -> DataFrame:
    """FAM columns and two alleles for every variant, in the order of vidx."""
    t = calls.join(variants.select("vidx", "major", "minor"), "vidx")
    a = F.when(F.col("g").isNull(), "0").when(F.col("g") > 0, F.col("minor")).otherwise(F.col("major"))
    b = F.when(F.col("g").isNull(), "0").when(F.col("g") > 1, F.col("minor")).otherwise(F.col("major"))
    row = t.groupBy("iid").agg(F.array_sort(F.collect_list(F.struct("vidx", F.concat_ws(" ", a, b).alias("x")))).alias("x"))
    return fam_lines(samples).select("line", F.get(F.split("line", "\t"), F.lit(1)).alias("iid")).join(row, "iid").select(F.concat_ws("\t", "line", F.array_join(F.transform("x", lambda r: r["x"]), "\t")).alias("line"))
