"""Queries of models, filters and event windows, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pedlake.operators import family_rare, filters, gene_tests, interactions, models, related
from pedlake.operators.cohort import Cohort
from pedlake.plans.association import BINARY, p_normal
from pedlake.plans.quality import _FREQ, _W, on_cohort
from pedlake.sources.tables import table
from pedlake.streaming import counts


def filtered_variants(c: Cohort) -> DataFrame:
    out = filters.filtered_variants(c, maf="[0.05,0.5]", call_rate=">=0.9", autosomes=True, passed=True, min_qual=30.0, snv_only=True, expr="NS < 200 and AF >= 0.9")
    return out.select("vidx", F.array_join("reasons", ",").alias("reasons"))


def regions(c: Cohort) -> DataFrame:
    r = c.variants.where("pos is not null").groupBy("chrom").agg(F.min("pos").alias("start"), F.expr("cast(min(pos) + (max(pos) - min(pos)) div 2 as int)").alias("end"))
    return filters.in_regions(c.variants, r).select("vidx")


def event_windows(spark: SparkSession, folder: str) -> DataFrame:
    return counts.event_windows(table(spark, folder, "events"))


QUERIES = {
    "linear_covariates": on_cohort(lambda c: models.linear_covariates(c, "AGE", ["P1", "P2"])),
    "logistic": on_cohort(lambda c: models.logistic(c, BINARY)),
    "filtered_variants": on_cohort(filtered_variants),
    "regions": on_cohort(regions),
    "thinned": on_cohort(lambda c: filters.thin(c.variants, 1_000_000)),
    "near_filtered": on_cohort(lambda c: filters.near_filtered(c.variants, c.variants.where("filt <> 'PASS'"), 100_000).select("vidx")),
    "flipped_alleles": on_cohort(lambda c: filters.recode_alleles(c.variants, "flip").select("vidx", "major", "minor")),
    "standardized": on_cohort(lambda c: filters.standardized(c.traits).where("val is not null").select("iid", "trait", "val")),
    "event_windows": event_windows,
    "blue_kinship": on_cohort(related.blue_freq),
    "qls_kinship": on_cohort(lambda c: related.qls_kinship(c, "AGE")),
    "mqls": on_cohort(lambda c: related.mqls(c, BINARY)),
    "rare_tdt": on_cohort(lambda c: related.rare_tdt(c, BINARY)),
    "weighted_sum": on_cohort(lambda c: related.weighted_sum(c, BINARY)),
    "pruned": on_cohort(related.prune),
    "lasso": on_cohort(lambda c: related.lasso(c, "AGE")),
    "linkage": on_cohort(related.linkage),
    "imputed": on_cohort(related.impute_mean),
    "inverse_normal": on_cohort(lambda c: related.inverse_normal(c, "AGE")),
    "kinship": on_cohort(related.kinship_pairs),
    "neighbours_dprime": on_cohort(interactions.neighbours_dprime),
    "interaction": on_cohort(lambda c: interactions.interaction(c, BINARY)),
    "mdr_triples": on_cohort(lambda c: interactions.mdr_triples(c, BINARY)),
    "sibling_similarity": on_cohort(interactions.pair_similarity),
    "dosage_histogram": on_cohort(interactions.dosage_histogram),
    "family_scores": on_cohort(lambda c: family_rare.family_scores(c, BINARY)),
    "family_burden": on_cohort(lambda c: family_rare.family_burden(c, BINARY)),
    "threshold_tests": on_cohort(lambda c: family_rare.threshold_tests(c, BINARY)),
    "joint_scores": on_cohort(lambda c: gene_tests.joint_scores(c, "AGE")),
    "family_kernels": on_cohort(lambda c: gene_tests.family_kernels(c, "AGE")),
    "family_threshold": on_cohort(lambda c: gene_tests.family_threshold(c, "AGE")),
    "pedcmc": on_cohort(lambda c: gene_tests.pedcmc(c, "AGE")),
    "multi_trait_genes": on_cohort(lambda c: gene_tests.multi_trait_scores(c, ["AGE", "AO"], c.sets)),
    "multi_trait_variants": on_cohort(lambda c: gene_tests.multi_trait_scores(c, ["AGE", "AO"], c.variants.select(F.col("vidx").cast("string").alias("gene"), "vidx"))),
    "score_export": on_cohort(lambda c: gene_tests.score_export(c, "AGE")),
    "kbac": on_cohort(lambda c: gene_tests.kbac(c, BINARY)),
    "rare_patterns": on_cohort(lambda c: gene_tests.pattern_counts(c, BINARY)),
    "thinned_sample": on_cohort(lambda c: filters.random_subset(c.samples, "iid", 0.5).select("iid")),
}

# kinship over common ancestors: T D T', T the halves of all lines up, D the Mendelian parts; parents of nobody related (checked below)
_KIN = "WITH RECURSIVE " + _W.removeprefix("WITH ") + """, l AS (SELECT iid, pat parent FROM s WHERE pat IS NOT NULL UNION ALL SELECT iid, mat FROM s WHERE mat IS NOT NULL),
  every AS (SELECT iid FROM s UNION SELECT parent FROM l), up(iid, top, w) AS (SELECT iid, iid, 1.0::DOUBLE FROM every UNION ALL SELECT up.iid, l.parent, up.w / 2 FROM up JOIN l ON l.iid = up.top),
  t AS MATERIALIZED (SELECT iid, top, sum(w) w FROM up GROUP BY ALL), d0 AS (SELECT e.iid, 1 - 0.25::DOUBLE * count(l.parent) d FROM every e LEFT JOIN l USING (iid) GROUP BY ALL),
  f0 AS (SELECT s.iid, coalesce(sum(a.w * b.w * d), 0) / 2 f FROM s LEFT JOIN t a ON a.iid = s.pat LEFT JOIN t b ON b.iid = s.mat AND b.top = a.top LEFT JOIN d0 ON d0.iid = a.top AND b.top IS NOT NULL GROUP BY s.iid),
  dd AS (SELECT d0.iid, d - 0.25 * coalesce((SELECT sum(f) FROM f0 JOIN l ON l.parent = f0.iid WHERE l.iid = d0.iid), 0) d FROM d0),
  kin AS (SELECT a.iid iid1, b.iid iid2, sum(a.w * b.w * d) kinship2 FROM t a JOIN t b ON a.top = b.top AND a.iid <= b.iid JOIN dd ON dd.iid = a.top GROUP BY ALL)"""

SQL = {
    "kinship": _KIN + " SELECT iid1, iid2, kinship2 FROM kin WHERE iid1 IN (SELECT iid FROM s) AND iid2 IN (SELECT iid FROM s) AND kinship2 <> 0",
    "linkage": _W + """, o AS (SELECT vidx, lead(vidx) OVER (PARTITION BY chrom ORDER BY pos, vidx) v2 FROM v WHERE chrom IS NOT NULL AND pos IS NOT NULL),
  t AS (SELECT k.vidx, k.iid, k.g child, s.pat, s.mat, a.g pa, b.g ma FROM g k JOIN s ON s.iid = k.iid JOIN g a ON a.vidx = k.vidx AND a.iid = s.pat JOIN g b ON b.vidx = k.vidx AND b.iid = s.mat WHERE k.g IS NOT NULL AND a.g IS NOT NULL AND b.g IS NOT NULL),
  e AS (SELECT vidx, iid, child, pat parent, pa p, ma o FROM t UNION ALL SELECT vidx, iid, child, mat, ma, pa FROM t),
  n AS (SELECT vidx, iid, parent, p, CASE WHEN p <> 1 THEN p // 2 WHEN o <> 1 THEN child - o // 2 WHEN child <> 1 THEN child // 2 END a FROM e), sent AS (SELECT * FROM n WHERE a IN (0, 1)),
  ff AS (SELECT sent.vidx, sent.iid parent, a from_father FROM sent JOIN s ON s.iid = sent.iid AND s.pat = sent.parent), kn AS (SELECT sent.vidx, sent.iid, sent.parent, (a = from_father)::INT origin FROM sent JOIN ff ON ff.vidx = sent.vidx AND ff.parent = sent.parent WHERE p = 1),
  m AS (SELECT a.vidx vidx1, o.v2 vidx2, count(*) FILTER (a.origin <> b.origin) n_rec, count(*) FILTER (a.origin = b.origin) n_non FROM kn a JOIN o ON o.vidx = a.vidx JOIN kn b ON b.vidx = o.v2 AND b.iid = a.iid AND b.parent = a.parent GROUP BY ALL)
  SELECT m.*, theta, CASE WHEN theta = 0 AND n_rec > 0 THEN NULL ELSE CASE WHEN n_rec > 0 THEN n_rec * log10(CASE WHEN theta > 0 THEN theta END) ELSE 0 END + n_non * log10(1 - theta) + (n_rec + n_non) * log10(2) END lod FROM m, (VALUES (0.0::DOUBLE), (0.01), (0.05), (0.1), (0.2), (0.3), (0.4)) q(theta)""",
    "filtered_variants": _FREQ + """, cr AS (SELECT vidx, 1 - (count(*) FILTER (g IS NULL))::DOUBLE / count(*) call_rate FROM g GROUP BY vidx),
  j AS (SELECT v.*, coalesce(maf, 0) m, coalesce(call_rate, 0) r, TRY_CAST(info['NS'] AS DOUBLE) ns, TRY_CAST(info['AF'] AS DOUBLE) af FROM v LEFT JOIN freq USING (vidx) LEFT JOIN cr USING (vidx))
  SELECT vidx, array_to_string(list_filter([CASE WHEN NOT chrom BETWEEN 1 AND 22 THEN 'autosome' END, CASE WHEN NOT (length(major) = 1 AND length(minor) = 1) THEN 'snv' END, CASE WHEN qual IS NULL OR qual < 30 THEN 'qual' END,
    CASE WHEN coalesce(filt <> 'PASS', true) THEN 'filter' END, CASE WHEN ns < 200 AND af >= 0.9 THEN 'expression' END, CASE WHEN NOT (m >= 0.05 AND m <= 0.5) THEN 'maf' END, CASE WHEN NOT r >= 0.9 THEN 'call_rate' END], lambda x: x IS NOT NULL), ',') reasons FROM j""",
    "regions": _W + ", b AS (SELECT chrom, min(pos) a, min(pos) + (max(pos) - min(pos)) // 2 z FROM v WHERE pos IS NOT NULL GROUP BY chrom) SELECT vidx FROM v JOIN b USING (chrom) WHERE pos BETWEEN a AND z",
    "near_filtered": _W + " SELECT DISTINCT a.vidx FROM v a JOIN v b ON a.chrom = b.chrom AND abs(a.pos - b.pos) <= 100000 WHERE b.filt <> 'PASS'",
    "thinned": "WITH RECURSIVE " + _W.removeprefix("WITH ") + """, o AS MATERIALIZED (SELECT chrom, pos, vidx FROM v WHERE chrom IS NOT NULL AND pos IS NOT NULL), k(chrom, pos) AS (SELECT chrom, min(pos) FROM o GROUP BY chrom
    UNION ALL SELECT k.chrom, (SELECT min(pos) FROM o WHERE o.chrom = k.chrom AND o.pos > k.pos + 1000000) FROM k WHERE EXISTS (SELECT 1 FROM o WHERE o.chrom = k.chrom AND o.pos > k.pos + 1000000))
  SELECT min(vidx) vidx FROM o JOIN k USING (chrom, pos) GROUP BY chrom, pos""",
    "flipped_alleles": _W + " SELECT vidx, reverse(translate(major, 'ACGTacgt', 'TGCAtgca')) major, reverse(translate(minor, 'ACGTacgt', 'TGCAtgca')) minor FROM v",
    "standardized": _W + ", d AS (SELECT trait, stddev_samp(val) sd FROM p GROUP BY trait) SELECT iid, trait, val / nullif(sd, 0) val FROM p JOIN d USING (trait) WHERE val / nullif(sd, 0) IS NOT NULL",
    "imputed": _W + ", f AS (SELECT vidx, avg(g) m FROM g WHERE g IS NOT NULL GROUP BY vidx) SELECT g.vidx, iid, coalesce(g::DOUBLE, m) d FROM g LEFT JOIN f ON f.vidx = g.vidx",
    "rare_tdt": _W + f""", y AS (SELECT iid FROM p WHERE trait = '{BINARY}' AND val = 2), t AS (SELECT k.vidx, k.g c, a.g pa, b.g ma FROM g k JOIN s ON s.iid = k.iid JOIN y ON y.iid = k.iid JOIN g a ON a.vidx = k.vidx AND a.iid = s.pat JOIN g b ON b.vidx = k.vidx AND b.iid = s.mat WHERE k.g IS NOT NULL AND a.g IS NOT NULL AND b.g IS NOT NULL),
  f AS (SELECT vidx, sum(pa + ma)::DOUBLE / (4 * count(*)) maf FROM t GROUP BY vidx), h AS (SELECT vidx, (pa = 1)::INT + (ma = 1)::INT het, c - (pa = 2)::INT - (ma = 2)::INT got FROM t),
  m AS (SELECT gene, cut, sum(got)::BIGINT n_transmitted, sum(het - got)::BIGINT n_not, count(DISTINCT vidx) n_variant FROM h JOIN f USING (vidx) JOIN gs USING (vidx), (VALUES (0.01::DOUBLE), (0.05::DOUBLE)) q(cut) WHERE het > 0 AND got BETWEEN 0 AND het AND maf <= cut GROUP BY ALL)
  SELECT *, (n_transmitted - n_not) / sqrt((n_transmitted + n_not)::DOUBLE) z FROM m""",
    "sibling_similarity": _W + """, k AS (SELECT g.vidx, g.iid, g.g, pat, mat FROM g JOIN s USING (iid) WHERE g.g IS NOT NULL AND pat IS NOT NULL AND mat IS NOT NULL), m AS (SELECT a.iid iid1, b.iid iid2, count(*) n, avg(1 - abs(a.g - b.g) / 2.0::DOUBLE) ibs, avg((a.g <> b.g)::INT) hamming,
    sum(a.g)::DOUBLE sx, sum(b.g)::DOUBLE sy, sum(a.g * a.g)::DOUBLE sxx, sum(b.g * b.g)::DOUBLE syy, sum(a.g * b.g)::DOUBLE sxy FROM k a JOIN k b ON a.vidx = b.vidx AND a.pat = b.pat AND a.mat = b.mat AND a.iid < b.iid GROUP BY ALL)
  SELECT iid1, iid2, n, ibs, hamming, CASE WHEN n*sxx - sx*sx > 0 AND n*syy - sy*sy > 0 THEN (n*sxy - sx*sy) / sqrt((n*sxx - sx*sx) * (n*syy - sy*sy)) END pearson FROM m""",
    "mdr_triples": _W + f""", y AS (SELECT iid, val = 2 c FROM p WHERE trait = '{BINARY}' AND val IN (1, 2)), k AS (SELECT gene, vidx, iid, g, c FROM g JOIN gs USING (vidx) JOIN y USING (iid) WHERE g IS NOT NULL),
  t AS (SELECT a.gene, a.vidx vidx1, b.vidx vidx2, d.vidx vidx3, a.g g1, b.g g2, d.g g3, count(*) FILTER (a.c) x, count(*) FILTER (NOT a.c) w FROM k a JOIN k b ON a.gene = b.gene AND a.iid = b.iid AND a.vidx < b.vidx JOIN k d ON a.gene = d.gene AND a.iid = d.iid AND b.vidx < d.vidx GROUP BY ALL),
  m AS (SELECT gene, vidx1, vidx2, vidx3, sum(x + w)::BIGINT n, sum(greatest(x, w))::BIGINT n_right, sum(x)::BIGINT n_case, sum(w)::BIGINT n_control, sum(CASE WHEN x > w THEN x ELSE 0 END)::DOUBLE tp, sum(CASE WHEN x <= w THEN w ELSE 0 END)::DOUBLE tn FROM t GROUP BY ALL)
  SELECT gene, vidx1, vidx2, vidx3, n, n_right, n_case, n_control, n_right::DOUBLE / n score, (tp / nullif(n_case, 0) + tn / nullif(n_control, 0)) / 2 balanced FROM m ORDER BY score DESC, n DESC, gene, vidx1, vidx2, vidx3 LIMIT 20""",
    "dosage_histogram": _W + ", f AS (SELECT vidx, avg(g) m FROM g WHERE g IS NOT NULL GROUP BY vidx), d AS (SELECT coalesce(g::DOUBLE, m) d FROM g LEFT JOIN f ON f.vidx = g.vidx) SELECT least(floor(d * 20 / 2), 19)::INTEGER bin, count(*) n FROM d WHERE d IS NOT NULL GROUP BY 1",
    "family_scores": _W + f""", y AS (SELECT iid FROM p WHERE trait = '{BINARY}' AND val = 2), t AS (SELECT k.vidx, k.iid, k.g c, a.g pa, b.g ma FROM g k JOIN s ON s.iid = k.iid JOIN y ON y.iid = k.iid JOIN g a ON a.vidx = k.vidx AND a.iid = s.pat JOIN g b ON b.vidx = k.vidx AND b.iid = s.mat WHERE k.g IS NOT NULL AND a.g IS NOT NULL AND b.g IS NOT NULL),
  f AS (SELECT vidx, (sum(pa + ma) + 1)::DOUBLE / (4 * count(*) + 1) q FROM t GROUP BY vidx) SELECT gene, iid, vidx, 25 * (1 - q)**24 * (c - (pa + ma) / 2.0::DOUBLE) u FROM t JOIN f USING (vidx) JOIN gs USING (vidx) WHERE 25 * (1 - q)**24 * (c - (pa + ma) / 2.0::DOUBLE) <> 0""",
    "event_windows": "SELECT date_trunc('hour', ts) AS start, event_type, count(*) n, sum(value) total FROM events GROUP BY ALL",
}

# Newton steps on the 2 x 3 table, one more by recursion each
_PR = ", ".join(f"1 / (1 + exp(-(b0 + b1 * {k}))) p{k}" for k in range(3))
_H = ", ".join(f"{e} {n}" for n, e in (("s0", " + ".join(f"(a{k} - n{k} * p{k})" for k in range(3))), ("s1", " + ".join(f"(a{k} - n{k} * p{k}) * {k}" for k in range(3))), ("h00", " + ".join(f"n{k} * p{k} * (1 - p{k})" for k in range(3))), ("h01", " + ".join(f"n{k} * p{k} * (1 - p{k}) * {k}" for k in range(3))), ("h11", " + ".join(f"n{k} * p{k} * (1 - p{k}) * {k * k}" for k in range(3)))))
SQL["logistic"] = "WITH RECURSIVE " + _W.removeprefix("WITH ") + f""", y AS (SELECT iid, val FROM p WHERE trait = '{BINARY}' AND val IN (1, 2)),
  t AS (SELECT vidx, {', '.join(f"(count(*) FILTER (val = 2 AND g = {k}))::DOUBLE a{k}, (count(*) FILTER (g = {k}))::DOUBLE n{k}" for k in range(3))} FROM g JOIN y USING (iid) WHERE g IS NOT NULL GROUP BY vidx),
  k AS (SELECT *, a0 + a1 + a2 > 0 AND a0 + a1 + a2 < n0 + n1 + n2 AND (n0 > 0)::INT + (n1 > 0)::INT + (n2 > 0)::INT > 1 ok FROM t),
  st(vidx, it, b0, b1, d) AS (SELECT vidx, 0, 0.0::DOUBLE, 0.0::DOUBLE, 1e9::DOUBLE FROM k WHERE ok UNION ALL
    SELECT vidx, it + 1, b0 + (h11 * s0 - h01 * s1) / det, b1 + (h00 * s1 - h01 * s0) / det, abs((h11 * s0 - h01 * s1) / det) + abs((h00 * s1 - h01 * s0) / det) FROM (SELECT *, h00 * h11 - h01 * h01 det FROM (SELECT *, {_H} FROM (SELECT st.*, k.* EXCLUDE (vidx, ok), {_PR} FROM st JOIN k USING (vidx) WHERE it < 20 AND d > 1e-6 AND abs(b1) < 500)))
    WHERE det <> 0 AND isfinite(s0 / det)),
  en AS (SELECT vidx, max(it) n_iter, arg_max(b0, it) b0, arg_max(b1, it) b1, arg_max(d, it) d FROM st GROUP BY vidx), z AS (SELECT *, b1 / sqrt(h00 / nullif(h00 * h11 - h01 * h01, 0)) stat FROM (SELECT *, {_H} FROM (SELECT en.*, k.* EXCLUDE (vidx), {_PR} FROM k LEFT JOIN en USING (vidx)))),
  f AS (SELECT k.vidx, coalesce(n_iter, 0)::INTEGER n_iter, k.ok AND d <= 1e-6 AND abs(b1) < 15 AND stat IS NOT NULL AND isfinite(stat) good, k.ok, b1, stat FROM k LEFT JOIN (SELECT * EXCLUDE (ok) FROM z) z USING (vidx)),
  fin AS (SELECT vidx, n_iter, CASE WHEN good THEN b1 END beta, CASE WHEN good THEN stat END stat, CASE WHEN coalesce(good, false) THEN NULL WHEN ok THEN 'separation' ELSE 'groups' END reason FROM f)
  SELECT *, {p_normal('stat')} p_regr FROM fin"""
