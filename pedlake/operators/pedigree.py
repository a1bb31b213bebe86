"""Pedigree description: sizes, sibships, relative pairs and familial correlation.

Pairs are counted, and their traits correlated, from sums over sibships: a sibship of n gives
n (n - 1) / 2 pairs, and the sum of products over its pairs is ((sum x)^2 - sum x^2) / 2. No pair is formed
except parent with child, of which there are at most two per row.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pedlake.operators.cohort import Cohort
from pedlake.plans.scratch import Scratch


def pairs_of(n: Column) -> Column:
    return n * (n - 1) / 2


def _pairs(n: Column) -> Column:
    return F.floor(pairs_of(n)).cast("long")


def families(c: Cohort) -> DataFrame:
    """Members, founders, non-founders, males, females and singletons per family."""
    s = c.samples.where("fid is not null")
    return s.groupBy("fid").agg(F.count(F.lit(1)).alias("n_member"), F.count_if("founder").alias("n_founder"), F.count_if(~F.col("founder")).alias("n_nonfounder"), F.count_if(F.col("sex") == 1).alias("n_male"), F.count_if(F.col("sex") == 2).alias("n_female")).withColumn("inheritance_bits", 2 * F.col("n_nonfounder") - F.col("n_founder"))


def family_summary(c: Cohort) -> DataFrame:
    """Number, mean, standard deviation (of the families as a whole, null for one) and range of family sizes."""
    return families(c).agg(F.count(F.lit(1)).alias("n_family"), F.avg("n_member").alias("mean_size"), F.when(F.count(F.lit(1)) > 1, F.stddev_pop("n_member")).alias("sd_size"), F.min("n_member").alias("min_size"), F.max("n_member").alias("max_size"))


def sibships(c: Cohort) -> DataFrame:
    """Children of each couple, by sex."""
    kids = c.samples.where("pat is not null and mat is not null")
    return kids.groupBy("pat", "mat").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("sex") == 1).alias("n_male"), F.count_if(F.col("sex") == 2).alias("n_female"))


def sibship_summary(c: Cohort) -> DataFrame:
    return sibships(c).agg(F.count(F.lit(1)).alias("n_sibship"), F.avg("n").alias("mean_size"), F.when(F.count(F.lit(1)) > 1, F.stddev_pop("n")).alias("sd_size"), F.min("n").alias("min_size"), F.max("n").alias("max_size"))


def multi_mates(c: Cohort) -> DataFrame:
    """Parents with children by more than one mate."""
    k = c.samples.where("pat is not null and mat is not null").select("pat", "mat").distinct()
    both = k.select(F.col("pat").alias("iid"), F.col("mat").alias("mate")).unionByName(k.select(F.col("mat").alias("iid"), F.col("pat").alias("mate")))
    return both.groupBy("iid").agg(F.count(F.lit(1)).alias("n_mate")).where("n_mate > 1")


def _links(c: Cohort) -> DataFrame:
    """(iid, parent) for each named parent, distinct."""
    return c.samples.select("iid", F.explode(F.filter(F.array("pat", "mat"), lambda p: p.isNotNull())).alias("parent")).distinct()


def pair_counts(c: Cohort) -> DataFrame:
    """Unordered pairs of the nine relations; parents and others count where they are named, recorded or not.

    Half sibs share just one known parent and have both known; avuncular pairs join a person with the
    full sibs of a parent; cousins are children of different members of one sibship.
    """
    sibs = sibships(c)
    links = _links(c)
    up = links.select(F.col("iid").alias("parent"), F.col("parent").alias("grand"))
    full = c.samples.where("pat is not null and mat is not null")
    by_parent = full.select(F.explode(F.array("pat", "mat")).alias("p")).groupBy("p").agg(F.count(F.lit(1)).alias("n"))
    size = sibs.withColumnRenamed("n", "n_sib").select("pat", "mat", "n_sib")
    parents = full.select(F.col("iid").alias("parent"), "pat", "mat").join(size, ["pat", "mat"])
    kids = links.groupBy("parent").agg(F.count(F.lit(1)).alias("k"))
    aunts = kids.join(parents, "parent").agg(F.sum(F.col("k") * (F.col("n_sib") - 1)).alias("n"))
    cousins = kids.join(parents, "parent").groupBy("pat", "mat").agg(F.sum("k").alias("s"), F.sum(F.col("k") * F.col("k")).alias("ss")).agg(F.sum((F.col("s") * F.col("s") - F.col("ss")) / 2).alias("n"))
    total = lambda df, e: df.agg(F.sum(e).alias("n"))
    n, m, w = F.col("n"), F.col("n_male"), F.col("n_female")
    half = total(by_parent, _pairs(n)).withColumn("z", F.lit(1)).join(total(sibs, _pairs(n)).select(F.col("n").alias("f"), F.lit(1).alias("z")), "z").select((F.col("n") - 2 * F.col("f")).alias("n"))
    rows = {
        "parent_offspring": links.agg(F.count(F.lit(1)).alias("n")), "sib": total(sibs, _pairs(n)), "sister_sister": total(sibs, _pairs(w)), "brother_brother": total(sibs, _pairs(m)), "brother_sister": total(sibs, m * w),
        "grandparent": links.join(up, "parent").agg(F.count(F.lit(1)).alias("n")), "avuncular": aunts, "half_sib": half, "cousin": cousins,
    }
    out = [df.select(F.lit(k).alias("relation"), F.coalesce(F.col("n").cast("long"), F.lit(0)).alias("n_pair")) for k, df in rows.items()]
    return reduce(DataFrame.unionByName, out)


def consanguineous(c: Cohort, generations: int = 2) -> DataFrame:
    """Couples with children whose nearest common ancestor, either mate included, is at most ``generations`` up
    from both, with the least sum of both distances."""
    couples = c.samples.where("pat is not null and mat is not null").select("pat", "mat").distinct()
    links = _links(c)
    mates = couples.select(F.explode(F.array("pat", "mat")).alias("iid")).distinct()
    up = mates.select("iid", F.col("iid").alias("top"), F.lit(0).alias("d"))
    lines = [up]
    for d in range(1, generations + 1):  # at most 2 ** d rows a mate
        up = up.join(links.select(F.col("iid").alias("top"), "parent"), "top").select("iid", F.col("parent").alias("top"), F.lit(d).alias("d")).distinct()
        lines.append(up)
    ancestors = reduce(DataFrame.unionByName, lines)
    a = couples.join(ancestors.select(F.col("iid").alias("pat"), "top", F.col("d").alias("d1")), "pat")
    shared = a.join(ancestors.select(F.col("iid").alias("mat"), "top", F.col("d").alias("d2")), ["mat", "top"])
    return shared.groupBy("pat", "mat").agg(F.min(F.col("d1") + F.col("d2")).alias("distance"))


def _corr(n: Column, sx: Column, sy: Column, sxx: Column, syy: Column, sxy: Column) -> Column:
    vx, vy = sxx - sx * sx / n, syy - sy * sy / n
    return F.when((vx > 1e-12) & (vy > 1e-12), (sxy - sx * sy / n) / F.sqrt(vx * vy))


def familial_correlation(c: Cohort, trait: str) -> DataFrame:
    """Pearson correlation of a trait over parent-offspring and full-sib pairs, each weighted alike; null
    for fewer than three pairs. Sib pairs enter in both orders."""
    y = c.trait(trait)
    po = _links(c).join(y.withColumnRenamed("val", "x"), "iid").join(y.select(F.col("iid").alias("parent"), F.col("val").alias("y")), "parent")
    x, z = F.col("x"), F.col("y")
    m1 = po.agg(F.count(F.lit(1)).alias("n_pair"), F.sum(x).alias("sx"), F.sum(z).alias("sy"), F.sum(x * x).alias("sxx"), F.sum(z * z).alias("syy"), F.sum(x * z).alias("sxy"))
    k = c.samples.where("pat is not null and mat is not null").select("iid", "pat", "mat").join(y, "iid").groupBy("pat", "mat").agg(F.count(F.lit(1)).alias("k"), F.sum("val").alias("s"), F.sum(F.col("val") * F.col("val")).alias("ss"))
    k1 = F.col("k") - 1
    m2 = k.agg(F.sum(_pairs(F.col("k"))).alias("n_pair"), F.sum(k1 * F.col("s")).alias("sx"), F.sum(k1 * F.col("s")).alias("sy"), F.sum(k1 * F.col("ss")).alias("sxx"), F.sum(k1 * F.col("ss")).alias("syy"), F.sum(F.col("s") * F.col("s") - F.col("ss")).alias("sxy"))
    out = []
    for name, m, n in (("parent_offspring", m1, F.col("n_pair")), ("sib", m2, 2 * F.col("n_pair"))):
        r = _corr(n.cast("double"), *(F.col(f"s{v}") for v in ("x", "y", "xx", "yy", "xy")))
        out.append(m.select(F.lit(name).alias("relation"), F.coalesce("n_pair", F.lit(0)).cast("long").alias("n_pair"), F.when(F.col("n_pair") > 2, r).alias("r")))
    return out[0].unionByName(out[1])


def trait_summary(c: Cohort) -> DataFrame:
    """Values, mean and standard deviation of each trait by sex and founder status."""
    t = c.traits.where("val is not null").join(c.samples.select("iid", "sex", "founder"), "iid")
    return t.groupBy("trait", "sex", "founder").agg(F.count(F.lit(1)).alias("n"), F.avg("val").alias("mean"), F.stddev_samp("val").alias("sd"))


def ibs_relatives(c: Cohort) -> DataFrame:
    """IBS, Hamming distance and number of shared calls of each recorded child and parent."""
    g = c.called()
    kid = g.join(_links(c), "iid")
    pair = kid.join(g.select("vidx", F.col("iid").alias("parent"), F.col("g").alias("h")), ["vidx", "parent"])
    d = F.abs(F.col("g").cast("int") - F.col("h").cast("int"))
    return pair.groupBy("iid", "parent").agg(F.count(F.lit(1)).alias("n"), F.avg(1 - d / 2).alias("ibs"), F.avg((d != 0).cast("int")).alias("hamming"))


def grm_relatives(c: Cohort) -> DataFrame:
    """Genomic relationship of each recorded child and parent, over variants with frequency in (0, 1)."""
    g = c.called()
    freq = g.groupBy("vidx").agg((F.avg("g") / 2).alias("p")).where("p > 0 and p < 1")
    std = g.join(freq, "vidx").select("vidx", "iid", ((F.col("g") - 2 * F.col("p")) / F.sqrt(2 * F.col("p") * (1 - F.col("p")))).alias("x"))
    pair = std.join(_links(c), "iid").join(std.select("vidx", F.col("iid").alias("parent"), F.col("x").alias("y")), ["vidx", "parent"])
    return pair.groupBy("iid", "parent").agg(F.count(F.lit(1)).alias("n"), F.avg(F.col("x") * F.col("y")).alias("grm"))


def relative_pairs(c: Cohort) -> DataFrame:
    """(relation, iid1, iid2): every unordered pair of the nine relations, the elder or lesser first; sib pairs stand once as ``sib`` and once
    by sex, where known. Pairs are formed inside sibships and along links only; half sibs inside a common parent's couples."""
    links = _links(c)
    full = c.samples.where("pat is not null and mat is not null").select("iid", "pat", "mat", "sex")
    two = full.select(F.col("iid").alias("iid2"), "pat", "mat", F.col("sex").alias("sex2"))
    sib = full.join(two, ["pat", "mat"]).where("iid < iid2")
    by_sex = F.when((F.col("sex") == 2) & (F.col("sex2") == 2), "sister_sister").when((F.col("sex") == 1) & (F.col("sex2") == 1), "brother_brother").when(F.col("sex").isin(1, 2) & F.col("sex2").isin(1, 2), "brother_sister")
    pair = lambda df, name, a, b: df.select((F.lit(name) if isinstance(name, str) else name).alias("relation"), F.col(a).alias("iid1"), F.col(b).alias("iid2"))
    up = links.select(F.col("iid").alias("parent"), F.col("parent").alias("grand"))
    both = sib.select(F.col("iid").alias("parent"), F.col("iid2").alias("aunt")).unionByName(sib.select(F.col("iid2").alias("parent"), F.col("iid").alias("aunt")))
    half = []
    for same, other in (("pat", "mat"), ("mat", "pat")):
        h = full.join(full.select(F.col("iid").alias("iid2"), same, F.col(other).alias("other")), same).where((F.col("iid") < F.col("iid2")) & (F.col(other) != F.col("other")))
        half.append(pair(h, "half_sib", "iid", "iid2"))
    cousins = links.join(sib.select(F.col("iid").alias("parent"), F.col("iid2").alias("q")), "parent").select(F.col("iid").alias("a"), "q").join(links.select(F.col("iid").alias("b"), F.col("parent").alias("q")), "q")
    parts = [
        pair(links, "parent_offspring", "parent", "iid"), pair(sib, "sib", "iid", "iid2"), pair(sib, by_sex, "iid", "iid2").where("relation is not null"), pair(links.join(up, "parent"), "grandparent", "grand", "iid"),
        pair(links.join(both, "parent"), "avuncular", "aunt", "iid"), *half, cousins.select(F.lit("cousin").alias("relation"), F.least("a", "b").alias("iid1"), F.greatest("a", "b").alias("iid2")),
    ]
    return reduce(DataFrame.unionByName, parts)


def relation_correlations(c: Cohort, trait: str, other: str | None = None, least: int = 3) -> DataFrame:
    """Correlation of a trait with itself, or with another trait, over the pairs of each relation and within persons (self).

    Pairs of one trait enter in both orders where the relation is symmetric. The standard error is the jackknife's over
    families of the first member, since pairs of one family depend on each other; p is that of the normal. Relations of fewer
    than ``least`` pairs are left out.
    """
    y = c.trait(trait).select("iid", F.col("val").alias("x"))
    z = c.trait(other or trait).select("iid", F.col("val").alias("z"))
    pairs = relative_pairs(c).where("iid1 != iid2")
    symmetric = F.col("relation").isin("sib", "sister_sister", "brother_brother", "half_sib", "cousin")
    turned = pairs.where(symmetric).select("relation", F.col("iid2").alias("iid1"), F.col("iid1").alias("iid2"))
    ends = pairs.withColumn("w", F.when(symmetric, 0.5).otherwise(1.0)).unionByName(turned.withColumn("w", F.lit(0.5)))
    t = ends.join(y.withColumnRenamed("iid", "iid1"), "iid1").join(z.withColumnRenamed("iid", "iid2"), "iid2")
    t = t.join(c.samples.select(F.col("iid").alias("iid1"), "fid"), "iid1", "left").select("relation", "fid", "w", "x", "z")
    if other is not None:
        own = y.join(z, "iid").join(c.samples.select("iid", "fid"), "iid", "left").select(F.lit("self").alias("relation"), "fid", F.lit(1.0).alias("w"), "x", "z")
        t = t.unionByName(own)
    names = {"n": F.col("w"), "sx": F.col("w") * F.col("x"), "sz": F.col("w") * F.col("z"), "sxx": F.col("w") * F.col("x") * F.col("x"), "szz": F.col("w") * F.col("z") * F.col("z"), "sxz": F.col("w") * F.col("x") * F.col("z")}
    fam = t.groupBy("relation", "fid").agg(*(F.sum(e).alias(k) for k, e in names.items()))
    whole = fam.groupBy("relation").agg(*(F.sum(k).alias(f"t_{k}") for k in names), F.count(F.lit(1)).alias("n_family"))

    def corr(v):
        vx, vz = v["sxx"] - v["sx"] * v["sx"] / v["n"], v["szz"] - v["sz"] * v["sz"] / v["n"]
        ok = (v["n"] > 1e-9) & (vx > 1e-12) & (vz > 1e-12)
        return F.when(ok, (v["sxz"] - v["sx"] * v["sz"] / v["n"]) / F.sqrt(F.when(ok, vx * vz)))

    left = fam.join(whole, "relation").withColumn("r_left", corr({k: F.col(f"t_{k}") - F.col(k) for k in names}))
    spread = left.groupBy("relation").agg(F.var_pop("r_left").alias("v"), F.count("r_left").alias("m"))
    out = whole.join(spread, "relation").where(F.col("t_n") > least - 1e-9).withColumn("r", corr({k: F.col(f"t_{k}") for k in names}))
    se = F.sqrt((F.col("m") - 1) * F.col("v"))
    out = out.select("relation", F.round("t_n").cast("long").alias("n_pair"), "n_family", "r", F.when(F.col("m") > 1, se).alias("se"))
    return out.withColumn("z", F.col("r") / F.nullif("se", F.lit(0.0)))


def generations(c: Cohort, most: int = 1000) -> DataFrame:
    """(iid, generation): 1 for persons without a named parent, else one more than the deepest parent's; persons on or below a cycle have null.

    Rounds of joins, as many as the deepest pedigree has generations; parents without a row count as the first.
    """
    scratch = Scratch(c.samples.sparkSession, "generations")
    links = scratch.cut(_links(c))
    named = scratch.cut(c.samples.select("iid").unionByName(links.select(F.col("parent").alias("iid"))).distinct())
    done = [scratch.cut(named.join(links.select("iid"), "iid", "left_anti").withColumn("generation", F.lit(1)))]
    for g in range(2, most):
        placed = reduce(DataFrame.unionByName, done).select(F.col("iid").alias("parent"), F.lit(True).alias("placed"))
        ready = links.join(placed, "parent", "left").groupBy("iid").agg(F.count_if(F.col("placed").isNull()).alias("n")).where("n = 0").select("iid")
        done.append(scratch.cut(ready.join(placed.select(F.col("parent").alias("iid")), "iid", "left_anti").withColumn("generation", F.lit(g))))
        if not scratch.rows:
            break
    return c.samples.select("iid").join(reduce(DataFrame.unionByName, done), "iid", "left")


def pedigree_loops(c: Cohort) -> DataFrame:
    """Per connected pedigree with a couple: persons named, couples, generations, marriage rings and all loops.

    In the graph of persons and couples, with an edge from a couple to each mate and each child, loops are edges - nodes + 1; rings
    are those of the edges to mates alone.
    """
    from pedlake.operators.components import components

    scratch = Scratch(c.samples.sparkSession, "loops")
    kids = scratch.cut(c.samples.select("iid", "pat", "mat"))
    both = kids.where("pat is not null and mat is not null")
    couple = F.concat_ws("\u0001", "pat", "mat")
    single = kids.where(F.col("pat").isNull() != F.col("mat").isNull()).select("iid", F.coalesce("pat", "mat").alias("mate"))
    mates = both.select(couple.alias("couple"), F.explode(F.array("pat", "mat")).alias("mate")).distinct()
    edges = scratch.cut(mates.select(F.concat(F.lit("c"), "couple").alias("a"), F.concat(F.lit("p"), "mate").alias("b"), F.lit(True).alias("mate")).unionByName(both.select(F.concat(F.lit("c"), couple).alias("a"), F.concat(F.lit("p"), "iid").alias("b"), F.lit(False).alias("mate"))).unionByName(single.select(F.concat(F.lit("p"), "mate").alias("a"), F.concat(F.lit("p"), "iid").alias("b"), F.lit(False).alias("mate"))))
    part = scratch.cut(components(edges))
    count = edges.join(part.withColumnRenamed("vertex", "a"), "a").groupBy("component").agg(F.count(F.lit(1)).alias("edges"))
    nodes = part.groupBy("component").agg(F.count(F.lit(1)).alias("nodes"), F.count_if(F.startswith("vertex", F.lit("p"))).alias("n_person"), F.count_if(F.startswith("vertex", F.lit("c"))).alias("n_couple"))
    rings = edges.where("mate")
    sub = scratch.cut(components(rings))
    ring_nodes = sub.groupBy("component").agg(F.count(F.lit(1)).alias("nodes"))
    ring_edges = rings.join(sub.withColumnRenamed("vertex", "a"), "a").groupBy("component", F.lit(1).alias("one")).agg(F.count(F.lit(1)).alias("edges"), F.min("a").alias("a"))
    per = ring_edges.join(ring_nodes, "component").select("a", (F.col("edges") - F.col("nodes") + 1).alias("ring")).join(part.withColumnRenamed("vertex", "a"), "a").groupBy("component").agg(F.sum("ring").alias("n_ring"))
    deep = generations(c).select(F.concat(F.lit("p"), "iid").alias("vertex"), "generation").join(part, "vertex").groupBy("component").agg(F.max("generation").alias("n_generation"))
    out = nodes.join(count, "component").join(per, "component", "left").join(deep, "component", "left").where("n_couple > 0")
    least = part.where(F.startswith("vertex", F.lit("p"))).groupBy("component").agg(F.min(F.substring("vertex", 2, 1 << 30)).alias("pedigree"))
    return out.join(least, "component").select("pedigree", "n_person", "n_couple", "n_generation", F.coalesce("n_ring", F.lit(0)).alias("n_ring"), (F.col("edges") - F.col("nodes") + 1).alias("n_loop"))
