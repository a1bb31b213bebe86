"""Queries of similar samples, mixed models and models with covariates, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pedlake.functions.keys import same_id
from pedlake.operators import assoc, mixed, models, related, similarity
from pedlake.operators.cohort import Cohort, load
from pedlake.plans.association import BINARY, CONTINUOUS, p_normal
from pedlake.plans.more import _KIN
from pedlake.plans.quality import _W, on_cohort
from pedlake.sources.tables import table


def every_20th(spark: SparkSession, folder: str) -> DataFrame:
    """The stated queries of searches: individuals of sample rows whose id is divisible by 20."""
    return table(spark, folder, "samples").where("sample_id % 20 = 0 and iid is not null").select(same_id("iid").alias("iid")).distinct()


def asking(f: Callable[[Cohort, DataFrame], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, folder: f(load(spark, folder), every_20th(spark, folder))


def sibling_pairs(c: Cohort) -> DataFrame:
    """Pairs of full siblings, formed inside couples."""
    k = c.samples.where("pat is not null and mat is not null").select("iid", "pat", "mat")
    return k.join(k.withColumnRenamed("iid", "iid2"), ["pat", "mat"]).where("iid < iid2").select(F.col("iid").alias("iid1"), "iid2")


def components_as_covariates(c: Cohort) -> DataFrame:
    return models.linear_covariates(similarity.with_components(c, similarity.principal_scores(c, 2)), CONTINUOUS, ["PC1", "PC2"])


QUERIES = {
    "similarity": asking(lambda c, q: similarity.similarity(similarity.pair_sums(c, q))),
    "nearest_samples": asking(lambda c, q: similarity.nearest_samples(similarity.pair_sums(c, q, names=["n", "d0", "d1"], best=5), 5)),
    "median_relationship": on_cohort(lambda c: similarity.median_relationship(c, sibling_pairs(c))),
    "kendall": on_cohort(lambda c: similarity.kendall(c, sibling_pairs(c))),
    "relationship_check": asking(lambda c, q: similarity.relationship_check(c, q, related.kinship_pairs(c))),
    "hybrid_relationship": asking(lambda c, q: similarity.hybrid(c, q, related.kinship_pairs(c))),
    "components": on_cohort(similarity.principal_scores),
    "components_as_covariates": on_cohort(components_as_covariates),
    "polygenic": on_cohort(lambda c: mixed.polygenic(c, CONTINUOUS)),
    "mixed_scan": on_cohort(lambda c: mixed.mixed_scan(c, CONTINUOUS)),
    "variant_blup": on_cohort(lambda c: mixed.variant_blup(c, CONTINUOUS)),
    "logistic_covariates": on_cohort(lambda c: mixed.logistic_covariates(c, BINARY, [CONTINUOUS])),
    "logistic_interaction": on_cohort(lambda c: mixed.logistic_covariates(c, BINARY, [CONTINUOUS], interaction=True)),
    "linear_interaction": on_cohort(lambda c: models.linear_covariates(c, CONTINUOUS, [BINARY], interaction=True)),
    "null_model": on_cohort(lambda c: mixed.null_model(c, CONTINUOUS, [BINARY])),
    "variant_covariate": on_cohort(lambda c: models.linear_covariates(similarity.variant_covariate(c, 0), CONTINUOUS, ["V0"])),
    "quick_epistasis_queries": on_cohort(lambda c: assoc.quick_epistasis_queries(c, BINARY, c.variants.where("vidx % 20 = 0"))),
    "epistasis_summary": on_cohort(lambda c: assoc.epistasis_summary(assoc.quick_epistasis(c, BINARY))),
}

_Q = _W + """, qq AS (SELECT DISTINCT upper(trim(iid, ' ' || chr(9))) iid FROM samples WHERE sample_id % 20 = 0 AND iid IS NOT NULL), f AS (SELECT vidx, avg(g) / 2 q FROM g WHERE g IS NOT NULL GROUP BY vidx),
pr AS (SELECT a.iid iid1, b.iid iid2, a.g::DOUBLE x, b.g::DOUBLE y, f.q p, 2 * f.q * (1 - f.q) v FROM g a JOIN qq ON qq.iid = a.iid JOIN g b ON b.vidx = a.vidx AND b.iid <> a.iid JOIN f ON f.vidx = a.vidx WHERE a.g IS NOT NULL AND b.g IS NOT NULL),
sm AS (SELECT iid1, iid2, count(*) n, avg(1 - abs(x - y) / 2) ibs, avg((x <> y)::INT) hamming, CASE WHEN count(*) * sum(x*x) - sum(x)**2 > 0 AND count(*) * sum(y*y) - sum(y)**2 > 0 THEN (count(*) * sum(x*y) - sum(x)*sum(y)) / sqrt((count(*) * sum(x*x) - sum(x)**2) * (count(*) * sum(y*y) - sum(y)**2)) END pearson,
  avg((x - 2*p) * (y - 2*p) / v) FILTER (v > 0) grm, sum((x - 2*p) * (y - 2*p)) FILTER (v > 0) / nullif(sum(v), 0) bn FROM pr GROUP BY ALL)"""
_SIB = _W + ", k AS (SELECT * FROM s WHERE pat IS NOT NULL AND mat IS NOT NULL), sp AS (SELECT a.iid iid1, b.iid iid2 FROM k a JOIN k b ON a.pat = b.pat AND a.mat = b.mat AND a.iid < b.iid)"
_Y = f", y AS (SELECT iid, val = 2 c FROM p WHERE trait = '{BINARY}' AND val IN (1, 2))"
_EPI = ", ".join(f"coalesce(sum({e}) FILTER ({f}), 0)::BIGINT {s}_{n}" for s, f in (("a", "c"), ("u", "NOT c")) for n, e in (("11", "g1*g2"), ("10", "g1*(2-g2)"), ("01", "(2-g1)*g2"), ("00", "(2-g1)*(2-g2)")))
_Z = "CASE WHEN least(a_11, a_10, a_01, a_00, u_11, u_10, u_01, u_00) > 0 THEN abs(ln(a_11::DOUBLE * a_00 / (a_10::DOUBLE * a_01)) - ln(u_11::DOUBLE * u_00 / (u_10::DOUBLE * u_01))) / sqrt(1.0::DOUBLE/a_11 + 1.0::DOUBLE/a_10 + 1.0::DOUBLE/a_01 + 1.0::DOUBLE/a_00 + 1.0::DOUBLE/u_11 + 1.0::DOUBLE/u_10 + 1.0::DOUBLE/u_01 + 1.0::DOUBLE/u_00) END z"
_GENE_EPI = _W + _Y + ", k AS (SELECT gene, vidx, iid, g, c FROM g JOIN gs USING (vidx) JOIN y USING (iid) WHERE g IS NOT NULL), t AS (SELECT a.gene, a.vidx vidx1, b.vidx vidx2, a.c, a.g g1, b.g g2 FROM k a JOIN k b ON a.gene = b.gene AND a.iid = b.iid AND a.vidx < b.vidx), m AS (SELECT gene, vidx1, vidx2, " + _EPI + f" FROM t GROUP BY ALL), e AS (SELECT *, {_Z} FROM m)"

SQL = {
    "similarity": _Q + " SELECT * FROM sm",
    "nearest_samples": _Q + ", r AS (SELECT *, row_number() OVER (PARTITION BY iid1 ORDER BY round(ibs, 12) DESC, n DESC, iid2) rank FROM sm) SELECT iid1, rank, iid2, n, ibs FROM r WHERE rank <= 5",
    "median_relationship": _SIB + """, f AS (SELECT vidx, avg(g) / 2 q FROM g WHERE g IS NOT NULL GROUP BY vidx HAVING avg(g) > 0 AND avg(g) < 2)
  SELECT iid1, iid2, median((a.g - 2*q) * (b.g - 2*q) / (2*q*(1-q))) median, count(*) n FROM sp JOIN g a ON a.iid = iid1 JOIN g b ON b.iid = iid2 AND a.vidx = b.vidx JOIN f ON f.vidx = a.vidx WHERE a.g IS NOT NULL AND b.g IS NOT NULL GROUP BY ALL""",
    "kendall": _SIB + """, t AS (SELECT iid1, iid2, a.vidx, a.g x, b.g y FROM sp JOIN g a ON a.iid = iid1 JOIN g b ON b.iid = iid2 AND a.vidx = b.vidx WHERE a.g IS NOT NULL AND b.g IS NOT NULL),
  n AS (SELECT iid1, iid2, count(*) n FROM t GROUP BY ALL), d AS (SELECT a.iid1, a.iid2, sum(sign(a.x - b.x) * sign(a.y - b.y)) s, count(*) FILTER (a.x <> b.x) ux, count(*) FILTER (a.y <> b.y) uy FROM t a JOIN t b ON a.iid1 = b.iid1 AND a.iid2 = b.iid2 AND a.vidx < b.vidx GROUP BY ALL)
  SELECT n.iid1, n.iid2, n, s / nullif(sqrt(ux::DOUBLE * uy), 0) tau FROM n LEFT JOIN d ON d.iid1 = n.iid1 AND d.iid2 = n.iid2""",
    "quick_epistasis_queries": _W + _Y + ", k AS (SELECT vidx, iid, g, c FROM g JOIN y USING (iid) WHERE g IS NOT NULL), t AS (SELECT a.vidx vidx1, b.vidx vidx2, a.c, a.g g1, b.g g2 FROM k a JOIN k b ON a.iid = b.iid AND a.vidx <> b.vidx WHERE a.vidx % 20 = 0), m AS (SELECT vidx1, vidx2, " + _EPI + f" FROM t GROUP BY ALL) SELECT *, {_Z} FROM m",
    "epistasis_summary": _GENE_EPI + ", b AS (SELECT DISTINCT * FROM (SELECT vidx1 vidx, vidx2 other, z FROM e UNION ALL SELECT vidx2, vidx1, z FROM e) WHERE z IS NOT NULL) SELECT vidx, count(*) FILTER (z > 3.8905918864131203) n_sig, count(*) n_total, (count(*) FILTER (z > 3.8905918864131203))::DOUBLE / count(*) prop, arg_max(other, (round(z, 10), -other)) best, max(z) best_z FROM b GROUP BY vidx",
}

_QK = "WITH RECURSIVE " + _Q.removeprefix("WITH ") + ", " + _KIN.split("FROM geneset)", 1)[1].lstrip("\n, ") + ", kr AS (SELECT * FROM kin WHERE iid1 <> iid2 AND kinship2 <> 0 AND iid1 IN (SELECT iid FROM s) AND iid2 IN (SELECT iid FROM s)), kb AS (SELECT iid1, iid2, kinship2 FROM kr UNION ALL SELECT iid2, iid1, kinship2 FROM kr), hk AS (SELECT sm.*, kinship2 FROM sm LEFT JOIN kb ON kb.iid1 = sm.iid1 AND kb.iid2 = sm.iid2)"
SQL |= {
    "hybrid_relationship": _QK + " SELECT iid1, iid2, coalesce(kinship2, grm) relationship, CASE WHEN kinship2 IS NOT NULL THEN 'pedigree' ELSE 'genotypes' END \"by\" FROM hk",
    "relationship_check": _QK + f""", zz AS (SELECT iid1, iid2, n, grm, coalesce(kinship2, 0) expected, (atanh(least(greatest(grm, -0.999), 0.999)) - atanh(least(greatest(coalesce(kinship2, 0), -0.999), 0.999))) * sqrt(n - 3.0::DOUBLE) z FROM hk WHERE n >= 30 AND grm IS NOT NULL),
  pz AS (SELECT *, {p_normal('z')} p FROM zz) SELECT * FROM pz WHERE p < 0.01""",
}
