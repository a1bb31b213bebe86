"""Queries of pedigree details, filters, MDR, linkage disequilibrium, trait distributions, simulation and sessions, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pedlake.operators import assoc, filters, gene_tests, genes, interactions, linkage_models, mixed, pathways, pedigree, qc, related, segregation, simulate, traits
from pedlake.operators.cohort import Cohort
from pedlake.plans.association import _TREND, BINARY, CONTINUOUS, p_fisher, p_normal, p_student
from pedlake.plans.families import _COL, _L
from pedlake.plans.more import SQL as MORE_SQL
from pedlake.plans.quality import _GS, _W, on_cohort
from pedlake.plans.scratch import Scratch
from pedlake.sources.tables import table
from pedlake.streaming import counts

#: A family of three generations for simulations.
FAMILY = [("a", None, None), ("b", None, None), ("c", "a", "b"), ("d", "a", "b"), ("e", None, None), ("f", "c", "e"), ("g", "d", None)]


def sessions(spark: SparkSession, folder: str) -> DataFrame:
    return counts.sessions(table(spark, folder, "events"))


def streamed_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Allele counts of the genotype table read as a stream, all that is there; state is kept per variant."""
    raw = table(spark, folder, "genotype")
    return counts.counted_once(counts.stream_of(spark, folder, raw, "genotype.parquet"))


def positional_pathways(c: Cohort) -> DataFrame:
    """Genes of a chromosome as a pathway, where no other pathways are known."""
    return genes.gene_summary(c).where("chrom is not null").select(F.concat(F.lit("chromosome "), "chrom").alias("pathway"), "gene")


def gene_drop(spark: SparkSession, folder: str) -> DataFrame:
    """Simulated genotypes of one family for as many variants as the folder has."""
    return simulate.gene_drop(spark, FAMILY, table(spark, folder, "variants").select("vidx").distinct().count())


def power(spark: SparkSession, folder: str) -> DataFrame:
    return simulate.power_range(spark, [100, 300, 1000, 3000, 10000], 0.2, 0.2, 0.3)


def gene_mixed(c: Cohort) -> DataFrame:
    """A gene's pooled burden through the mixed-model scan: genes stand in the place of variants, numbered by name."""
    from pedlake.operators.genes import collapsed

    burden = collapsed(c).select("gene", "iid", "burden")
    genes = burden.select("gene").distinct().withColumn("vidx", F.xxhash64("gene"))
    pooled = burden.join(genes, "gene").select("vidx", "iid", F.col("burden").alias("g"))
    t = mixed.mixed_scan(Cohort(c.samples, pooled, c.traits, c.variants, c.sets), CONTINUOUS)
    return genes.join(t, "vidx").drop("vidx")


def cut_lods(c: Cohort) -> DataFrame:
    return Scratch(c.samples.sparkSession, "lods").cut(linkage_models.pedigree_lods(c, BINARY))


def filtered_samples(c: Cohort) -> DataFrame:
    out = filters.filter_samples(c, ranges=["20<AGE<=60", "P1<P2"], status="case", trait=BINARY, sexes=[1])
    return out.select("iid", F.array_join("reasons", ",").alias("reasons"))


def error_filtered(c: Cohort) -> DataFrame:
    out = filters.error_rules(c, trait=BINARY, mendel_share="[0,0.05]", missing_p=0.05, gdist="[10,100]", info_af="[0.05,0.5]")
    return out.select("vidx", F.array_join("reasons", ",").alias("reasons"))


def marker_check(c: Cohort) -> DataFrame:
    """Against a reference of every other variant, with every third's alleles changed."""
    ref = c.variants.where("vidx % 2 = 0").select("id", "chrom", "pos", "major", F.when(F.col("vidx") % 3 == 0, F.lit("N")).otherwise(F.col("minor")).alias("minor"))
    return qc.marker_check(c, ref)


QUERIES = {
    "relative_pairs": on_cohort(pedigree.relative_pairs),
    "relation_correlations": on_cohort(lambda c: pedigree.relation_correlations(c, CONTINUOUS)),
    "cross_correlations": on_cohort(lambda c: pedigree.relation_correlations(c, CONTINUOUS, BINARY)),
    "generations": on_cohort(pedigree.generations),
    "pedigree_loops": on_cohort(pedigree.pedigree_loops),
    "inbreeding": on_cohort(qc.inbreeding),
    "inbreeding_x": on_cohort(lambda c: qc.inbreeding(c, True)),
    "missing_test": on_cohort(lambda c: qc.missing_test(c, BINARY)),
    "marker_check": on_cohort(marker_check),
    "sample_dosages": on_cohort(qc.sample_dosages),
    "sdt": on_cohort(lambda c: assoc.sdt(c, BINARY)),
    "corrected": on_cohort(lambda c: assoc.corrected(assoc.trend(c, BINARY).select("vidx", "stat_trend"), "stat_trend", 1.1)),
    "reported": on_cohort(lambda c: assoc.reported(assoc.trend_test(c, BINARY).select("vidx", "p_trend"), "p_trend", "[0,0.05]", True)),
    "pair_regression": on_cohort(lambda c: assoc.pair_regression(c, CONTINUOUS)),
    "fqls": on_cohort(lambda c: related.mqls(c, BINARY, plain=True)),
    "filtered_samples": on_cohort(filtered_samples),
    "error_filtered": on_cohort(error_filtered),
    "mdr_folds": on_cohort(lambda c: interactions.mdr_folds(c, BINARY)),
    "mdr_residual": on_cohort(lambda c: interactions.mdr_scores(c, CONTINUOUS)),
    "mdr_fuzzy": on_cohort(lambda c: interactions.mdr_scores(c, BINARY, "fuzzy")),
    "mdr_grown": on_cohort(lambda c: interactions.mdr_grown(c, BINARY)),
    "mdr_permuted": on_cohort(lambda c: interactions.mdr_permuted(c, BINARY)),
    "ld_within": on_cohort(lambda c: interactions.ld_within(c, 2_000_000)),
    "pruned_vif": on_cohort(related.prune_vif),
    "linkage_verdict": on_cohort(related.linkage_verdict),
    "genotype_elimination": on_cohort(related.genotype_elimination),
    "lod_scores": on_cohort(lambda c: linkage_models.lod_scores(linkage_models.pedigree_lods(c, BINARY))),
    "linkage_test": on_cohort(lambda c: linkage_models.linkage_test(cut_lods(c))),
    "homogeneity": on_cohort(lambda c: linkage_models.homogeneity(cut_lods(c))),
    "sharing_linkage": on_cohort(lambda c: linkage_models.sharing_linkage(c, BINARY)),
    "conditional_variance": on_cohort(related.conditional_variance),
    "imputed_relatives": on_cohort(related.impute_relatives),
    "kinship_x": on_cohort(related.kinship_x),
    "gene_mixed": on_cohort(gene_mixed),
    "commingling": on_cohort(lambda c: traits.commingling(c, CONTINUOUS)),
    "ridge": on_cohort(lambda c: traits.ridge(c, CONTINUOUS)),
    "partial_least_squares": on_cohort(lambda c: traits.partial_least_squares(c, CONTINUOUS)),
    "longitudinal_kernel": on_cohort(lambda c: gene_tests.longitudinal(c, [CONTINUOUS, "AO"])),
    "segregation": on_cohort(lambda c: segregation.segregation(c, CONTINUOUS)),
    "pathway_regression": on_cohort(lambda c: pathways.pathway_regression(c, CONTINUOUS, positional_pathways(c))),
    "skat_by_frequency": on_cohort(lambda c: gene_tests.skat(c, BINARY, weight="maf", call_rate=0.5)),
    "streamed_counts": streamed_counts,
    "sessions": sessions,
    "gene_drop": gene_drop,
    "power": power,
}

_REL = _L + """, sx AS (SELECT a.iid i, b.iid j, a.sex si, b.sex sj FROM k a JOIN k b ON a.pat = b.pat AND a.mat = b.mat AND a.iid < b.iid), sb2 AS (SELECT i, j FROM sx UNION ALL SELECT j, i FROM sx),
rel AS (SELECT 'parent_offspring' relation, parent iid1, iid iid2 FROM l UNION ALL SELECT 'sib', i, j FROM sx UNION ALL SELECT 'sister_sister', i, j FROM sx WHERE si = 2 AND sj = 2 UNION ALL SELECT 'brother_brother', i, j FROM sx WHERE si = 1 AND sj = 1
  UNION ALL SELECT 'brother_sister', i, j FROM sx WHERE (si = 1 AND sj = 2) OR (si = 2 AND sj = 1) UNION ALL SELECT 'grandparent', b.parent, a.iid FROM l a JOIN l b ON a.parent = b.iid UNION ALL SELECT 'avuncular', q.j, l.iid FROM l JOIN sb2 q ON l.parent = q.i
  UNION ALL SELECT 'half_sib', a.iid, b.iid FROM k a JOIN k b ON a.iid < b.iid AND ((a.pat = b.pat AND a.mat <> b.mat) OR (a.mat = b.mat AND a.pat <> b.pat))
  UNION ALL SELECT 'cousin', least(a.iid, b.iid), greatest(a.iid, b.iid) FROM l a JOIN sx ON sx.i = a.parent JOIN l b ON b.parent = sx.j)"""


def _correlations(other: str | None) -> str:
    own = "" if other is None else " UNION ALL SELECT 'self', s.fid, 1.0::DOUBLE, y.x, z.z FROM y JOIN z USING (iid) LEFT JOIN s ON s.iid = y.iid"
    r = lambda n, sx, sz, sxx, szz, sxz: f"CASE WHEN {n} > 1e-9 AND {sxx} - ({sx})**2/{n} > 1e-12 AND {szz} - ({sz})**2/{n} > 1e-12 THEN ({sxz} - ({sx})*({sz})/{n}) / sqrt(({sxx} - ({sx})**2/{n}) * ({szz} - ({sz})**2/{n})) END"
    names = ("n", "sx", "sz", "sxx", "szz", "sxz")
    return _REL + f""", y AS (SELECT iid, val x FROM p WHERE trait = '{CONTINUOUS}' AND val IS NOT NULL), z AS (SELECT iid, val z FROM p WHERE trait = '{other or CONTINUOUS}' AND val IS NOT NULL),
  e AS (SELECT relation, iid1, iid2, CASE WHEN relation IN ('sib', 'sister_sister', 'brother_brother', 'half_sib', 'cousin') THEN 0.5 ELSE 1.0 END::DOUBLE w FROM rel WHERE iid1 <> iid2 UNION ALL SELECT relation, iid2, iid1, 0.5 FROM rel WHERE iid1 <> iid2 AND relation IN ('sib', 'sister_sister', 'brother_brother', 'half_sib', 'cousin')),
  t AS (SELECT relation, s.fid, w, y.x, z.z FROM e JOIN y ON y.iid = iid1 JOIN z ON z.iid = iid2 LEFT JOIN s ON s.iid = iid1{own}),
  f AS (SELECT relation, fid, sum(w) n, sum(w*x) sx, sum(w*z) sz, sum(w*x*x) sxx, sum(w*z*z) szz, sum(w*x*z) sxz FROM t GROUP BY ALL), h AS (SELECT relation, {', '.join(f'sum({v}) t_{v}' for v in names)}, count(*) n_family FROM f GROUP BY relation),
  q AS (SELECT relation, {r(*(f'(t_{v} - {v})' for v in names))} rl FROM f JOIN h USING (relation)), v2 AS (SELECT relation, var_pop(rl) v, count(rl) m FROM q GROUP BY relation),
  o AS (SELECT relation, round(t_n)::BIGINT n_pair, n_family, {r(*(f't_{v}' for v in names))} r, CASE WHEN m > 1 THEN sqrt((m - 1) * v) END se FROM h JOIN v2 USING (relation) WHERE t_n > 3 - 1e-9) SELECT *, r / nullif(se, 0) z FROM o"""


def _inbreeding(where: str, who: str) -> str:
    return _W + f""", c AS (SELECT g.vidx, g.iid, g.g, s.sex FROM g JOIN s USING (iid) WHERE g.g IS NOT NULL), q AS (SELECT vidx, sum(g)::DOUBLE a, count(*)::DOUBLE n FROM c GROUP BY vidx), e AS (SELECT vidx, a / (2*n) p, 1 - 2 * (a/(2*n)) * (1 - a/(2*n)) e FROM q JOIN v USING (vidx) WHERE a > 0 AND a < 2*n AND {where}),
  r AS (SELECT iid, count(*) FILTER (g <> 1) obs_hom, sum(e) exp_hom, sum(CASE WHEN p > 0.5 THEN 2 - g ELSE g END)::BIGINT mac, count(*) n FROM c JOIN e USING (vidx) WHERE {who} GROUP BY iid) SELECT *, CASE WHEN abs(n - exp_hom) > 1e-9 THEN (obs_hom - exp_hom) / (n - exp_hom) END f FROM r"""


_Y = f", y AS (SELECT iid, val = 2 c FROM p WHERE trait = '{BINARY}' AND val IN (1, 2))"
_PAIRS = _W + _Y + ", k AS (SELECT gene, vidx, iid, g, c FROM g JOIN gs USING (vidx) JOIN y USING (iid) WHERE g IS NOT NULL), t AS (SELECT a.gene, a.vidx vidx1, b.vidx vidx2, a.iid, a.g g1, b.g g2, a.c FROM k a JOIN k b ON a.gene = b.gene AND a.iid = b.iid AND a.vidx < b.vidx)"
_MT = _W + f""", m AS (SELECT vidx, count(*) FILTER (g IS NULL AND val = 2) case_missing, count(*) FILTER (g IS NOT NULL AND val = 2) case_called, count(*) FILTER (g IS NULL AND val <> 2) control_missing, count(*) FILTER (g IS NOT NULL AND val <> 2) control_called FROM g JOIN p USING (iid) WHERE trait = '{BINARY}' AND val IS NOT NULL GROUP BY vidx),
  mp AS (SELECT *, {p_fisher('case_missing', 'case_called', 'control_missing', 'control_called')} p_missing FROM m)"""

SQL = {
    "relative_pairs": _REL + " SELECT * FROM rel",
    "relation_correlations": _correlations(None),
    "cross_correlations": _correlations(BINARY),
    "generations": "WITH RECURSIVE " + _L.removeprefix("WITH ") + """, every AS (SELECT iid FROM s UNION SELECT parent FROM l), d(iid, top, g) AS (SELECT iid, iid, 1 FROM every UNION ALL SELECT d.iid, l.parent, d.g + 1 FROM d JOIN l ON l.iid = d.top WHERE d.g < 60)
  SELECT s.iid, CASE WHEN max(g) < 60 THEN max(g) END::INTEGER generation FROM s JOIN d USING (iid) GROUP BY s.iid""",
    "inbreeding": _inbreeding("chrom BETWEEN 1 AND 22", "true"),
    "inbreeding_x": _inbreeding("chrom = 23", "sex = 2"),
    "missing_test": _MT + " SELECT * FROM mp",
    "marker_check": _W + """, r AS (SELECT id, chrom rc, pos rp, list_sort([major, CASE WHEN vidx % 3 = 0 THEN 'N' ELSE minor END]) ra FROM v WHERE vidx % 2 = 0),
  t AS (SELECT vidx, v.id, CASE WHEN ra IS NULL THEN 'id' WHEN chrom IS DISTINCT FROM rc OR pos IS DISTINCT FROM rp THEN 'position' WHEN list_sort([major, minor]) IS DISTINCT FROM ra THEN 'alleles' END reason FROM v LEFT JOIN r ON r.id = v.id WHERE v.id IS NOT NULL AND v.id <> '.') SELECT * FROM t WHERE reason IS NOT NULL""",
    "sample_dosages": _W + ", f AS (SELECT vidx, avg(g) m FROM g WHERE g IS NOT NULL GROUP BY vidx) SELECT iid, least(floor(coalesce(g::DOUBLE, m) * 20 / 2), 19)::INTEGER bin, count(*) n FROM g JOIN f ON f.vidx = g.vidx GROUP BY ALL",
    "sdt": _W + _Y + """, t AS (SELECT g.vidx, pat, mat, avg(g.g) FILTER (c) a, avg(g.g) FILTER (NOT c) u FROM g JOIN s USING (iid) JOIN y USING (iid) WHERE g.g IS NOT NULL AND pat IS NOT NULL AND mat IS NOT NULL GROUP BY ALL HAVING count(*) FILTER (c) > 0 AND count(*) FILTER (NOT c) > 0),
  m AS (SELECT vidx, count(*) FILTER (a > u) n_more, count(*) FILTER (a < u) n_less, count(*) n_sibship FROM t GROUP BY vidx) SELECT *, (n_more - n_less)::DOUBLE**2 / nullif(n_more + n_less, 0) stat_sdt FROM m""",
    "corrected": _TREND + f", x2 AS (SELECT vidx, stat_trend, stat_trend / 1.1::DOUBLE stat_trend_gc FROM r) SELECT *, {p_normal('sqrt(stat_trend_gc)')} p_gc FROM x2",
    "reported": _TREND + f", x2 AS (SELECT vidx, {p_normal('sqrt(stat_trend)')} p_trend FROM r) SELECT * FROM x2 WHERE p_trend <= 0.05",
    "filtered_samples": _W + f""", w AS (SELECT iid, max(val) FILTER (trait = 'AGE') age, max(val) FILTER (trait = 'P1') p1, max(val) FILTER (trait = 'P2') p2, max(val) FILTER (trait = '{BINARY}') tr FROM p GROUP BY iid), j AS (SELECT s.*, age, p1, p2, tr FROM s LEFT JOIN w USING (iid))
  SELECT iid, array_to_string(list_filter([CASE WHEN sex IS DISTINCT FROM 1 THEN 'sex' END, CASE WHEN age <= 20 OR age > 60 THEN 'range 20<AGE<=60' END, CASE WHEN p1 >= p2 THEN 'range P1<P2' END, CASE WHEN tr IS DISTINCT FROM 2 THEN 'status' END], lambda x: x IS NOT NULL), ',') reasons FROM j""",
    "error_filtered": _MT.replace(_W, _W + """, tt AS (SELECT k.vidx, k.g child, a.g pa, b.g ma FROM g k JOIN s ON s.iid = k.iid LEFT JOIN g a ON a.vidx = k.vidx AND a.iid = s.pat AND a.g IS NOT NULL LEFT JOIN g b ON b.vidx = k.vidx AND b.iid = s.mat AND b.g IS NOT NULL WHERE k.g IS NOT NULL AND (a.g IS NOT NULL OR b.g IS NOT NULL)),
  me AS (SELECT vidx, avg((child < (coalesce(pa, 0) = 2)::INT + (coalesce(ma, 0) = 2)::INT OR child > (coalesce(pa, 1) > 0)::INT + (coalesce(ma, 1) > 0)::INT)::INT) prop FROM tt GROUP BY vidx)""", 1) + """, j AS (SELECT v.vidx, coalesce(prop, 0) pr, p_missing, gdist, TRY_CAST(info['AF'] AS DOUBLE) af FROM v LEFT JOIN me USING (vidx) LEFT JOIN mp USING (vidx))
  SELECT vidx, array_to_string(list_filter([CASE WHEN pr > 0.05 THEN 'mendel' END, CASE WHEN p_missing < 0.05 THEN 'missing' END, CASE WHEN gdist < 10 OR gdist > 100 THEN 'gdist' END, CASE WHEN NOT CASE WHEN af > 0.5 THEN 1 - af ELSE af END BETWEEN 0.05 AND 0.5 THEN 'info_af' END], lambda x: x IS NOT NULL), ',') reasons FROM j""",
    "mdr_folds": _PAIRS + """, d AS (SELECT *, ('0x' || substr(md5(iid), 1, 8))::BIGINT % 5 fold FROM t), fo AS (SELECT f fold FROM range(5) r(f)),
  ce AS (SELECT gene, vidx1, vidx2, g1, g2, count(*) FILTER (c) a, count(*) FILTER (NOT c) u FROM d GROUP BY ALL), pf AS (SELECT gene, vidx1, vidx2, fold, g1, g2, count(*) FILTER (c) a, count(*) FILTER (NOT c) u FROM d GROUP BY ALL), pw AS (SELECT DISTINCT gene, vidx1, vidx2, fold FROM pf),
  tr AS (SELECT ce.gene, ce.vidx1, ce.vidx2, pw.fold, ce.g1, ce.g2, ce.a - coalesce(pf.a, 0) ta, ce.u - coalesce(pf.u, 0) tu, coalesce(pf.a, 0) ea, coalesce(pf.u, 0) eu FROM ce JOIN pw ON pw.gene = ce.gene AND pw.vidx1 = ce.vidx1 AND pw.vidx2 = ce.vidx2 LEFT JOIN pf ON pf.gene = ce.gene AND pf.vidx1 = ce.vidx1 AND pf.vidx2 = ce.vidx2 AND pf.fold = pw.fold AND pf.g1 = ce.g1 AND pf.g2 = ce.g2),
  sc AS (SELECT gene, vidx1, vidx2, fold, sum(greatest(ta, tu)) r, sum(ta + tu) n, sum(CASE WHEN ta > tu THEN ea ELSE eu END) er, sum(ea + eu) en FROM tr GROUP BY ALL HAVING sum(ta + tu) > 0),
  bs AS (SELECT *, row_number() OVER (PARTITION BY gene, fold ORDER BY r::DOUBLE / n DESC, n DESC, vidx1, vidx2) = 1 best FROM sc)
  SELECT gene, vidx1, vidx2, sum(r)::DOUBLE / sum(n) train, sum(er)::DOUBLE / nullif(sum(en), 0) test, count(*) FILTER (best) consistency FROM bs GROUP BY ALL ORDER BY consistency DESC, test DESC, train DESC, gene, vidx1, vidx2 LIMIT 20""",
    "mdr_residual": _W + f""", y AS (SELECT iid, val - avg(val) OVER () r FROM p WHERE trait = '{CONTINUOUS}' AND val IS NOT NULL), k AS (SELECT gene, vidx, iid, g, r FROM g JOIN gs USING (vidx) JOIN y USING (iid) WHERE g IS NOT NULL),
  ce AS (SELECT a.gene, a.vidx vidx1, b.vidx vidx2, a.g g1, b.g g2, sum(greatest(a.r, 0)) x, sum(greatest(-a.r, 0)) w FROM k a JOIN k b ON a.gene = b.gene AND a.iid = b.iid AND a.vidx < b.vidx GROUP BY ALL)
  SELECT gene, vidx1, vidx2, sum(greatest(x, w)) / nullif(sum(x + w), 0) score FROM ce GROUP BY ALL ORDER BY round(score, 10) DESC, gene, vidx1, vidx2 LIMIT 20""",
    "mdr_fuzzy": _PAIRS + """, ce AS (SELECT gene, vidx1, vidx2, g1, g2, count(*) FILTER (c)::DOUBLE a, count(*) FILTER (NOT c)::DOUBLE u FROM t GROUP BY ALL), w AS (SELECT *, sum(a) OVER (PARTITION BY gene, vidx1, vidx2) n1, sum(u) OVER (PARTITION BY gene, vidx1, vidx2) n0 FROM ce),
  h AS (SELECT *, least(1, greatest(0, log10((a + 0.5::DOUBLE) / (n1 + 0.5) * (n0 + 0.5) / (u + 0.5)) + 0.5)) m FROM w), sc AS (SELECT gene, vidx1, vidx2, (sum(a * m) / nullif(max(n1), 0) + sum(u * (1 - m)) / nullif(max(n0), 0)) / 2 score FROM h GROUP BY ALL)
  SELECT * FROM sc WHERE score IS NOT NULL ORDER BY round(score, 10) DESC, gene, vidx1, vidx2 LIMIT 20""",
    "mdr_grown": _PAIRS + """, ce AS (SELECT gene, vidx1, vidx2, g1, g2, count(*) FILTER (c) a, count(*) FILTER (NOT c) u FROM t GROUP BY ALL), sc AS (SELECT gene, vidx1, vidx2, sum(a + u) n, sum(greatest(a, u)) r FROM ce GROUP BY ALL),
  b AS (SELECT *, r::DOUBLE / n score2, row_number() OVER (PARTITION BY gene ORDER BY r::DOUBLE / n DESC, n DESC, vidx1, vidx2) q FROM sc), t3 AS (SELECT t.gene, t.vidx1, t.vidx2, k.vidx vidx3, g1, g2, k.g g3, count(*) FILTER (t.c) a, count(*) FILTER (NOT t.c) u FROM b JOIN t ON t.gene = b.gene AND t.vidx1 = b.vidx1 AND t.vidx2 = b.vidx2 JOIN k ON k.gene = t.gene AND k.iid = t.iid AND k.vidx <> t.vidx1 AND k.vidx <> t.vidx2 WHERE q <= 5 GROUP BY ALL),
  s3 AS (SELECT gene, vidx1, vidx2, vidx3, sum(a + u)::BIGINT n3, sum(greatest(a, u))::DOUBLE / sum(a + u) score3 FROM t3 GROUP BY ALL), z AS (SELECT *, row_number() OVER (PARTITION BY gene, vidx1, vidx2 ORDER BY score3 DESC, n3 DESC, vidx3) q3 FROM s3)
  SELECT z.gene, z.vidx1, z.vidx2, score2, vidx3, n3, score3 FROM z JOIN b ON b.gene = z.gene AND b.vidx1 = z.vidx1 AND b.vidx2 = z.vidx2 WHERE q3 = 1""",
    "ld_within": _GS.split(", c AS")[0] + """, o AS (SELECT vidx, chrom, pos FROM v WHERE chrom IS NOT NULL AND pos IS NOT NULL), pr AS (SELECT a.vidx vidx1, b.vidx vidx2 FROM o a JOIN o b ON a.chrom = b.chrom AND abs(a.pos - b.pos) <= 2000000 AND a.vidx < b.vidx),
  m AS (SELECT vidx1, vidx2, count(*) n, sum(a.g)::DOUBLE sx, sum(b.g)::DOUBLE sy, sum(a.g*a.g)::DOUBLE sxx, sum(b.g*b.g)::DOUBLE syy, sum(a.g*b.g)::DOUBLE sxy FROM pr JOIN g a ON a.vidx = vidx1 JOIN g b ON b.vidx = vidx2 AND a.iid = b.iid WHERE a.g IS NOT NULL AND b.g IS NOT NULL GROUP BY ALL),
  r AS (SELECT vidx1, vidx2, n, CASE WHEN n*sxx - sx*sx > 0 AND n*syy - sy*sy > 0 THEN (n*sxy - sx*sy) / sqrt((n*sxx - sx*sx) * (n*syy - sy*sy)) END r FROM m) SELECT *, r * r r2 FROM r""",
}

_LK = MORE_SQL["linkage"]
SQL |= {
    "streamed_counts": "SELECT vidx, sum(g)::BIGINT a, count(g) n FROM genotype WHERE g IS NOT NULL GROUP BY vidx",
    "linkage_verdict": "WITH b AS (" + _LK + """), c AS (SELECT vidx1, vidx2, n_rec, n_non, lod lod_05, least(n_rec::DOUBLE / (n_rec + n_non), 0.5) theta FROM b WHERE theta = 0.05),
  d AS (SELECT *, CASE WHEN n_rec > 0 THEN n_rec * log10(CASE WHEN theta > 0 THEN theta END) ELSE 0 END + CASE WHEN n_non > 0 THEN n_non * log10(1 - theta) ELSE 0 END + (n_rec + n_non) * log10(2) lod FROM c)
  SELECT *, CASE WHEN lod >= 3 THEN 'LINKED' WHEN lod >= 1.73 THEN 'POSSIBLE' WHEN lod_05 <= -2 THEN 'NOT_LINKED' ELSE 'AMBIGUOUS' END verdict FROM d""",
    "sessions": """WITH a AS (SELECT user_id, ts, CASE WHEN ts <= lag(ts) OVER w + INTERVAL 30 MINUTE THEN 0 ELSE 1 END new FROM events WHERE ts IS NOT NULL WINDOW w AS (PARTITION BY user_id ORDER BY ts)), b AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) k FROM a)
  SELECT min(ts) AS start, user_id, count(*) n FROM b GROUP BY user_id, k""",
}
SQL |= {
    "rare_patterns": _COL + f""", y AS (SELECT iid, val = 2 c FROM p WHERE trait = '{BINARY}' AND val IN (1, 2)), t AS (SELECT gene, mm.iid, c, string_agg(vidx || ':' || m, ',' ORDER BY vidx) pattern FROM mm JOIN gs USING (vidx) JOIN y ON y.iid = mm.iid WHERE maf > 0 AND maf <= 0.05 AND m > 0 GROUP BY ALL)
  SELECT gene, pattern, count(*) FILTER (c) n_case, count(*) FILTER (NOT c) n_control FROM t GROUP BY ALL""",
    "null_model": _W + f""", d AS (SELECT a.val y, b.val x FROM p a JOIN p b USING (iid) WHERE a.trait = '{CONTINUOUS}' AND b.trait = '{BINARY}' AND a.val IS NOT NULL AND b.val IS NOT NULL),
  m AS (SELECT count(*) n, avg(x) mx, regr_slope(y, x) b, regr_intercept(y, x) a, regr_sxx(y, x) sxx, regr_syy(y, x) - regr_sxy(y, x)**2 / regr_sxx(y, x) rss FROM d),
  t AS (SELECT 'intercept' term, n, a beta, a / sqrt(rss / (n - 2) * (1.0::DOUBLE / n + mx**2 / sxx)) stat FROM m UNION ALL SELECT '{BINARY}', n, b, b / sqrt(rss / (n - 2) / sxx) FROM m) SELECT *, {p_student('stat', 'n - 2')} p_regr FROM t""",
}
