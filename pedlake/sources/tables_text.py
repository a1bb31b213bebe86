"""Text tables beside genotypes: covariates with ranges, factors and powers, gene sets in five layouts, pathways, relationships,
frequencies, weights, estimates, type probabilities, genetic maps, permutations, parameters and sequences."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pedlake.sources.formats import WHITE, _field, _lines, chromosome, number, read_traits
from pedlake.sources.registry import reader


def expand_names(wanted: str, names: list[str]) -> list[tuple[str, str, str | int | None]]:
    """(name of the result, column, what) of a list such as ``AGE,P*,A-C,BMI^2,factor(SITE)``: ``*`` takes any letters, a-b the columns
    from a to b, ``^k`` a power, ``factor()`` one indicator for each value but the least."""
    out: list[tuple[str, str, str | int | None]] = []
    for item in (x.strip() for x in wanted.split(",") if x.strip()):
        if m := re.fullmatch(r"factor\((.+)\)", item):
            out.append((m[1], m[1], "factor"))
        elif m := re.fullmatch(r"(.+)\^(\d+)", item):
            out.append((item, m[1], int(m[2])))
        elif "*" in item:
            rule = re.compile(".*".join(map(re.escape, item.split("*"))))
            out += [(n, n, None) for n in names if rule.fullmatch(n)]
        elif item not in names and "-" in item and len(ends := [e for e in ([item[:i], item[i + 1 :]] for i, ch in enumerate(item) if ch == "-") if e[0] in names and e[1] in names]) == 1:
            a, b = names.index(ends[0][0]), names.index(ends[0][1])
            out += [(n, n, None) for n in names[min(a, b) : max(a, b) + 1]]
        else:
            out.append((item, item, None))
    missing = [c for _, c, _ in out if c not in names]
    if missing:
        raise ValueError(f"no column {', '.join(missing)}")
    return list(dict.fromkeys(out))


def select_traits(traits: DataFrame, wanted: str) -> DataFrame:
    """Long traits (iid, trait, kind, val) of a list of names, see ``expand_names``; the names' order is that of the alphabet for ranges."""
    names = sorted(r["trait"] for r in traits.select("trait").distinct().collect())  # a row per column of the file
    parts = []
    for name, column, what in expand_names(wanted, names):
        t = traits.where(F.col("trait") == column)
        if what == "factor":
            values = sorted(r["val"] for r in t.where("val is not null").select("val").distinct().limit(1001).collect())
            if len(values) > 1000:
                raise ValueError(f"{column} has more than 1000 values")
            parts += [t.select("iid", F.lit(f"{column}={v:g}").alias("trait"), F.lit("continuous").alias("kind"), (F.col("val") == v).cast("double").alias("val")) for v in values[1:]]
        elif isinstance(what, int):
            parts.append(t.select("iid", F.lit(name).alias("trait"), "kind", F.pow("val", F.lit(float(what))).alias("val")))
        else:
            parts.append(t.select("iid", "trait", "kind", "val"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _words(spark: SparkSession, path: str) -> DataFrame:
    return _lines(spark, path).select("file_path", F.monotonically_increasing_id().alias("at"), F.split("line", WHITE).alias("f"))


def _at(i: int):
    return F.get("f", F.lit(i))


def read_gene_set(spark: SparkSession, path: str, layout: str, variants: DataFrame | None = None) -> DataFrame:
    """(gene, id) of a file in one of five layouts: ``pair`` (variant gene), ``gene_first`` (gene variant), ``row`` (gene and its variants on a
    line), ``block`` (gene, its variants one a line, END), ``range`` (gene chr start end: the variants inside)."""
    w = _words(spark, path)
    if layout in ("pair", "gene_first"):
        a, b = (_at(1), _at(0)) if layout == "pair" else (_at(0), _at(1))
        return w.where(F.size("f") >= 2).select(a.alias("gene"), b.alias("id")).distinct()
    if layout == "row":
        return w.select(_at(0).alias("gene"), F.explode(F.slice("f", 2, F.size("f"))).alias("id")).distinct()
    if layout == "block":
        # a name starts after an END or at the start of its file; running sums per file tell a line's block
        order = Window.partitionBy("file_path").orderBy("at")
        t = w.withColumn("first", F.coalesce(F.upper(F.lag(_at(0)).over(order)) == "END", F.lit(True)))
        t = t.withColumn("block", F.sum(F.col("first").cast("int")).over(order)).withColumn("gene", F.max(F.when(F.col("first"), _at(0))).over(Window.partitionBy("file_path", "block")))
        return t.where(~F.col("first") & (F.upper(_at(0)) != "END")).select("gene", _at(0).alias("id")).distinct()
    if layout == "range":
        from pedlake.operators.genes import range_join

        if variants is None:
            raise ValueError("ranges need the variants")
        r = w.select(_at(0).alias("gene"), chromosome(_at(1)).alias("chrom"), _at(2).try_cast("int").alias("start"), _at(3).try_cast("int").alias("end"))
        return range_join(variants.where("pos is not null").select("id", "chrom", "pos"), r).select("gene", "id").distinct()
    raise ValueError(f"no layout {layout}")


def read_pathways(spark: SparkSession, path: str) -> DataFrame:
    """(pathway, gene): a pathway and its genes on a line."""
    return _words(spark, path).select(_at(0).alias("pathway"), F.explode(F.slice("f", 2, F.size("f"))).alias("gene")).distinct()


def pathway_sets(pathways: DataFrame, sets: DataFrame) -> DataFrame:
    """(gene, vidx) with pathways in the place of genes."""
    return pathways.join(sets, "gene").select(F.col("pathway").alias("gene"), "vidx").distinct()


def read_relationships(spark: SparkSession, path: str, layout: str = "pair") -> DataFrame:
    """(iid1, iid2, value) of a file of pairs (iid iid value), or of a square matrix whose first line names its samples."""
    w = _words(spark, path)
    if layout == "pair":
        return w.select(_at(0).alias("iid1"), _at(1).alias("iid2"), _at(2).try_cast("double").alias("value")).where("value is not null")
    if layout != "matrix":
        raise ValueError(f"no layout {layout}")
    n = number(w, "at")
    names = n.where("n = 0").select("file_path", F.col("f").alias("names"))
    cells = n.where("n > 0").join(F.broadcast(names), "file_path").select("names", F.get("names", (F.col("n") - 1).cast("int")).alias("iid1"), F.posexplode(F.slice("f", F.size("f") - F.size("names") + 1, F.size("names"))).alias("i", "x"))
    return cells.select("iid1", F.get("names", F.col("i")).alias("iid2"), F.col("x").try_cast("double").alias("value")).where("iid1 is not null and value is not null")


def read_by_variant(spark: SparkSession, path: str, column: str = "value") -> DataFrame:
    """(id, value): frequencies, variant weights or estimates, one a line; a header or any other text gives no row."""
    return _words(spark, path).select(_at(0).alias("id"), F.element_at("f", -1).try_cast("double").alias(column)).where(f"{column} is not null")


def read_by_sample(spark: SparkSession, path: str, column: str = "value") -> DataFrame:
    """(fid, iid, value): sample weights or breeding values."""
    return _words(spark, path).select(_at(0).alias("fid"), _at(1).alias("iid"), F.element_at("f", -1).try_cast("double").alias(column)).where(f"{column} is not null")


def read_types(spark: SparkSession, path: str) -> DataFrame:
    """(pedigree, iid, p_aa, p_ab, p_bb) of a type-probability file, which has a penetrance for each type of each person."""
    f = [_at(i) for i in range(5)]
    return _words(spark, path).select(f[0].alias("pedigree"), f[1].alias("iid"), *(x.try_cast("double").alias(n) for x, n in zip(f[2:], ("p_aa", "p_ab", "p_bb")))).where("p_bb is not null")


def read_parameters(spark: SparkSession, path: str) -> dict[str, str]:
    """Parameters ``name = value`` of a text in blocks: names in a block get its name and a dot; # starts a comment. Read whole by the driver."""
    text = "\n".join(r["value"] for r in spark.read.text(path, wholetext=True).collect())
    out, where = {}, []
    for token in re.findall(r"[{}]|[^{}\n;]+", re.sub(r"#[^\n]*", "", text)):
        t = token.strip()
        if t == "}":
            where = where[:-1]
        elif t == "{":
            where.append(last)
            out.pop(".".join(where), None)
        elif t:
            last, _, value = (x.strip() for x in t.partition("="))
            last = last.split(",")[0].strip() if not value else last
            out[".".join([*where, last])] = value.strip('"')
    return out


def read_genetic_map(spark: SparkSession, path: str) -> DataFrame:
    """(chrom, id, gdist) of a map CHROMOSOME MARKER POSITION, in centimorgans."""
    return _lines(spark, path).select(chromosome(_field(0)).alias("chrom"), _field(1).alias("id"), _field(2).try_cast("double").alias("gdist")).where("chrom is not null and gdist is not null")


def read_permutations(spark: SparkSession, path: str) -> DataFrame:
    """(perm_id, place, index): a permutation on each line, as places from 0."""
    t = number(_words(spark, path), "at")
    return t.select((F.col("n") + 1).alias("perm_id"), F.posexplode("f").alias("place", "x")).select("perm_id", "place", F.col("x").try_cast("long").alias("index")).where("index is not null")


def read_sequences(spark: SparkSession, path: str, width: int = 0) -> DataFrame:
    """(name, start, bases) of a FASTA file, a row per line with the place of its first base from 1.

    A sequence's length stays spread over lines. The place of a line needs the bases before it in its sequence: counts per
    partition of the file, then offsets; partitions are told by the line's running id.
    """
    lines = spark.read.text(path).select(F.monotonically_increasing_id().alias("at"), F.btrim("value", F.lit(" \t\r")).alias("line"), "_metadata.file_path").where("line != ''")
    head = F.startswith("line", F.lit(">"))
    t = lines.withColumn("part", F.shiftright("at", 33)).withColumn("n", F.when(head, 0).otherwise(F.length("line")))
    inside = Window.partitionBy("file_path", "part").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    t = t.withColumns({"run": F.sum("n").over(inside), "name_here": F.last(F.when(head, F.regexp_extract("line", r"^>\s*(\S+)", 1)), True).over(inside), "base": F.last(F.when(head, F.sum("n").over(inside)), True).over(inside)})
    # a row per partition: bases after its last name, or all of them and no name
    ends = t.groupBy("file_path", "part").agg(F.max("run").alias("all"), F.max_by("name_here", "at").alias("last"), F.max_by("base", "at").alias("base"))
    before = Window.partitionBy("file_path").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.withColumn("group", F.coalesce(F.sum(F.col("last").isNotNull().cast("int")).over(before), F.lit(0)))
    ends = ends.withColumn("carried", F.last("last", True).over(before)).withColumn("left", F.when(F.col("last").isNotNull(), F.col("all") - F.col("base")).otherwise(F.col("all")))
    since = Window.partitionBy("file_path", "group").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    previous = ends.select("file_path", "part", "carried", F.coalesce(F.sum(F.when(F.col("last").isNull(), F.col("left"))).over(since), F.lit(0)).alias("between"), F.last(F.when(F.col("last").isNotNull(), F.col("left")), True).over(before).alias("tail"))
    t = t.join(previous, ["file_path", "part"]).where(~head)
    start = F.when(F.col("name_here").isNotNull(), F.col("run") - F.col("base")).otherwise(F.col("run") + F.col("between") + F.coalesce("tail", F.lit(0))) - F.col("n") + 1
    return t.select(F.coalesce("name_here", "carried").alias("name"), start.cast("long").alias("start"), F.upper("line").alias("bases")).where("name is not null")


def reference_bases(variants: DataFrame, sequences: DataFrame) -> DataFrame:
    """(vidx, base, matches): the reference base at each position, and whether it is the variant's major or minor allele."""
    seq = sequences.select(chromosome(F.col("name")).alias("chrom"), "start", (F.col("start") + F.length("bases") - 1).alias("end"), "bases").where("chrom is not null")
    from pedlake.operators.genes import range_join

    hit = range_join(variants.where("pos is not null").select("vidx", "chrom", "pos", "major", "minor"), seq, 10_000)
    base = F.substring("bases", (F.col("pos") - F.col("start") + 1).cast("int"), F.lit(1))
    return hit.select("vidx", base.alias("base"), F.when(F.col("major") == base, "major").when(F.col("minor") == base, "minor").otherwise("none").alias("matches"))


def read_expression(spark: SparkSession, path: str) -> DataFrame:
    """(id, iid, value) of a matrix with samples named on the first line and a feature on each further line."""
    t = number(_words(spark, path), "at")
    names = t.where("n = 0").select("file_path", F.col("f").alias("names"))
    rows = t.where("n > 0").join(F.broadcast(names), "file_path").select(_at(0).alias("id"), F.slice("names", F.size("names") - F.size("f") + 2, F.size("f") - 1).alias("names"), F.posexplode(F.slice("f", 2, F.size("f"))).alias("i", "x"))
    return rows.select("id", F.get("names", F.col("i")).alias("iid"), F.col("x").try_cast("double").alias("value"))


def read_mach(spark: SparkSession, path: str, info: str) -> tuple[DataFrame, DataFrame]:
    """(variants, dosages): a sample a line as FAMILY->ID DOSE and its dosages, in the order of the info file (id, alleles, frequency)."""
    v = number(_words(spark, info), "at").where(F.lower(_at(0)) != "snp")
    first = v.agg(F.min("n")).first()[0] or 0  # a header may come before
    variants = v.select((F.col("n") - first).alias("vidx"), _at(0).alias("id"), _at(1).alias("minor"), _at(2).alias("major"), _at(3).try_cast("double").alias("freq"))
    who = F.split(_at(0), "->")
    d = _words(spark, path).select(F.get(who, F.lit(0)).alias("fid"), F.element_at(who, -1).alias("iid"), F.posexplode(F.slice("f", 3, F.size("f"))).alias("vidx", "x"))
    return variants, d.select(F.col("vidx").cast("long").alias("vidx"), "fid", "iid", F.col("x").try_cast("double").alias("d"))


def read_meta(spark: SparkSession, path: str) -> DataFrame:
    """(id, n, beta, se, p) of a table of results with a header, whose columns are found by their usual names."""
    lines = _lines(spark, path)
    head = lines.select("line").first()
    names = [x.upper() for x in re.split(r"[ \t]+", head["line"])] if head else []
    known = {"id": ("VARIANT", "SNP", "ID", "MARKER"), "n": ("N", "NSAMP", "NMISS"), "beta": ("BETA", "EFFECT", "B"), "se": ("SE", "STDERR"), "p": ("P", "PVALUE", "P_REGR", "P-VALUE")}
    cols = []
    for out, any_of in known.items():
        at = next((i for i, n in enumerate(names) if n in any_of), None)
        x = F.lit(None).cast("string") if at is None else _field(at)
        cols.append((x if out == "id" else x.try_cast("double")).alias(out))
    return lines.where(F.col("line") != (head["line"] if head else "")).select(*cols).where("id is not null")


def meta_fixed(results: DataFrame) -> DataFrame:
    """Inverse-variance meta-analysis per variant: beta, se, z, heterogeneity Q and its degrees of freedom."""
    t = results.where("beta is not null and se > 0").withColumn("w", 1 / (F.col("se") * F.col("se")))
    m = t.groupBy("id").agg(F.count(F.lit(1)).alias("n_study"), F.sum("w").alias("w"), F.sum(F.col("w") * F.col("beta")).alias("wb"), F.sum(F.col("w") * F.col("beta") * F.col("beta")).alias("wbb"))
    return m.select("id", "n_study", (F.col("wb") / F.col("w")).alias("beta"), F.sqrt(1 / F.col("w")).alias("se"), (F.col("wb") / F.sqrt("w")).alias("z"), (F.col("wbb") - F.col("wb") * F.col("wb") / F.col("w")).alias("q"), (F.col("n_study") - 1).alias("df"))


@reader("traits")
def _traits(spark, path, **options):
    return {"traits": read_traits(spark, path, **options)}


@reader("expression")
def _expression(spark, path, **options):
    return {"expression": read_expression(spark, path)}


@reader("mach")
def _mach(spark, path, info: str, **options):
    variants, dosages = read_mach(spark, path, info)
    return {"variants": variants, "dosages": dosages}


def read_haplotypes(spark: SparkSession, path: str, positions: str) -> tuple[DataFrame, DataFrame]:
    """(variants, haplotypes) of simulated haplotypes: lines NUMBER POPULATION ALLELE..., 1 the derived and 2 the ancestral allele, and a file of
    positions NUMBER CHROM POS with a header. haplotypes: (haplotype, pop, vidx, allele), 1 derived, 0 ancestral."""
    v = number(_words(spark, positions), "at").where(_at(0).try_cast("int").isNotNull())
    first = v.agg(F.min("n")).first()[0] or 0  # a header may come before
    variants = v.select((F.col("n") - first).alias("vidx"), chromosome(_at(1)).alias("chrom"), _at(2).try_cast("double").cast("int").alias("pos"))
    h = _words(spark, path).select(_at(0).alias("haplotype"), _at(1).alias("pop"), F.posexplode(F.slice("f", 3, F.size("f"))).alias("vidx", "x"))
    return variants, h.select("haplotype", "pop", F.col("vidx").cast("long").alias("vidx"), F.when(F.col("x") == "1", 1).when(F.col("x") == "2", 0).alias("allele"))
