"""Queries of quality control, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pedlake.operators import qc
from pedlake.operators.cohort import COHORT_SQL, Cohort, load


def on_cohort(f: Callable[[Cohort], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, folder: f(load(spark, folder))


QUERIES = {
    "allele_freq": on_cohort(qc.allele_freq),
    "hwe": on_cohort(qc.hwe),
    "hwe_founders": on_cohort(lambda c: qc.hwe(c, True)),
    "hwe_exact": on_cohort(lambda c: qc.hwe_test(c).select("vidx", "p_exact")),
    "variant_missing": on_cohort(qc.variant_missing),
    "sample_counts": on_cohort(qc.sample_counts),
    "heterozygosity": on_cohort(qc.heterozygosity),
    "mendel_family": on_cohort(lambda c: qc.mendel(c, "fid")),
    "mendel_sample": on_cohort(lambda c: qc.mendel(c, "iid")),
    "mendel_variant": on_cohort(lambda c: qc.mendel(c, "vidx")),
    "mendel_errors": on_cohort(lambda c: qc.mendel_cells(c).where("error").drop("error")),
    "fst": on_cohort(qc.fst),
    "fst_gene": on_cohort(qc.fst_by_gene),
    "density": on_cohort(qc.density),
    "tstv": on_cohort(qc.tstv),
    "rare_lists": on_cohort(qc.rare_lists),
    "family_unique": on_cohort(lambda c: qc.unique_to(c, "fid")),
    "population_unique": on_cohort(lambda c: qc.unique_to(c, "pop")),
    "variant_summary": on_cohort(qc.variant_summary),
    "missing_traits": on_cohort(qc.missing_traits),
    "missing_sex": on_cohort(qc.missing_sex),
    "missing_by_status": on_cohort(lambda c: qc.missing_by_status(c, "ET")),
    "top_variants": on_cohort(qc.top_variants),
    "sizes": on_cohort(lambda c: c.sizes()),
}

_W = "WITH " + COHORT_SQL
_GS = _W + ", c AS (SELECT g.vidx, g.iid, g.g, s.fid, s.pop, s.founder FROM g JOIN s USING (iid) WHERE g.g IS NOT NULL)"
_FREQ = _GS + """, f0 AS (SELECT vidx, sum(g)::BIGINT a, count(*)::BIGINT n, coalesce(sum(g) FILTER (founder), 0)::BIGINT fa, count(*) FILTER (founder) fn FROM c GROUP BY vidx),
f1 AS (SELECT *, a::DOUBLE / (2 * n) p, CASE WHEN fn = 0 THEN 0.0::DOUBLE ELSE fa::DOUBLE / (2 * fn) END pf FROM f0),
freq AS (SELECT vidx, CASE WHEN pf > 0.5 THEN 1 - p ELSE p END maf, CASE WHEN pf > 0.5 THEN 2 * n - a ELSE a END mac, a mac_raw, CASE WHEN pf > 0.5 THEN 1 - pf ELSE pf END fmaf, n nind, fn nfounder, pf > 0.5 flipped FROM f1)"""
_RARE = _FREQ + ", rare AS (SELECT vidx, CASE least(mac_raw, 2 * nind - mac_raw) WHEN 0 THEN 'monomorphic' WHEN 1 THEN 'singleton' WHEN 2 THEN 'doubleton' END kind FROM freq WHERE least(mac_raw, 2 * nind - mac_raw) < 3)"


def _hwe_sql(where: str) -> str:
    return _GS + f""", n AS (SELECT vidx, count(*) FILTER (g = 0) n0, count(*) FILTER (g = 1) n1, count(*) FILTER (g = 2) n2, count(*)::DOUBLE n FROM c {where} GROUP BY vidx),
q AS (SELECT *, (n1 + 2 * n2) / (2 * n) p FROM n)
SELECT vidx, n0, n1, n2, n1 / n o_het, 2 * p * (1 - p) e_het, CASE WHEN p > 0 AND p < 1 THEN (n0 - n*(1-p)*(1-p))**2 / (n*(1-p)*(1-p)) + (n1 - 2*n*p*(1-p))**2 / (2*n*p*(1-p)) + (n2 - n*p*p)**2 / (n*p*p) END stat_hwe FROM q"""


_CELLS = _W + """, t AS (SELECT s.fid, k.iid, k.vidx, k.g child, a.g pa, b.g ma FROM g k JOIN s ON s.iid = k.iid LEFT JOIN g a ON a.vidx = k.vidx AND a.iid = s.pat AND a.g IS NOT NULL LEFT JOIN g b ON b.vidx = k.vidx AND b.iid = s.mat AND b.g IS NOT NULL
  WHERE k.g IS NOT NULL AND (a.g IS NOT NULL OR b.g IS NOT NULL)),
m AS (SELECT fid, iid, vidx, pa g_pat, ma g_mat, child g, child < (coalesce(pa, 0) = 2)::INT + (coalesce(ma, 0) = 2)::INT OR child > (coalesce(pa, 1) > 0)::INT + (coalesce(ma, 1) > 0)::INT error FROM t)"""
_FST = _GS + """, q AS (SELECT vidx, pop, count(*)::DOUBLE n, sum(g)::BIGINT a, sum(g) / (2.0::DOUBLE * count(*)) p FROM c WHERE pop IS NOT NULL GROUP BY vidx, pop),
t AS (SELECT vidx, sum(n) N1, sum(n * p) np, sum(n * p * p) npp, sum(n * n) nn, count(*)::DOUBLE k, sum(a) a FROM q GROUP BY vidx HAVING sum(a) > 0 AND count(*) > 1 AND sum(n) > count(*)),
u AS (SELECT vidx, k, (npp - N1 * (np / N1) * (np / N1)) / (k - 1) msp, (np - npp) / (N1 - k) msg, (N1 - nn / N1) / (k - 1) nc FROM t),
w AS (SELECT vidx, k::BIGINT n_pop, msp - msg num, msp + (nc - 1) * msg den FROM u)"""
_SNV = "(major IN ('A', 'C', 'G', 'T') AND minor IN ('A', 'C', 'G', 'T') AND major <> minor)"


def _mendel_sql(by: str) -> str:
    return _CELLS + f" SELECT {by}, count(*) FILTER (error) n_error, count(*) n_avail, (count(*) FILTER (error))::DOUBLE / count(*) prop FROM m GROUP BY {by}"


def _unique_sql(by: str) -> str:
    return _GS + f" SELECT vidx, min({by}) {by}, count(*) n_carrier FROM c WHERE g > 0 AND {by} IS NOT NULL GROUP BY vidx HAVING min({by}) = max({by})"


SQL = {
    "allele_freq": _FREQ + " SELECT * FROM freq",
    "hwe": _hwe_sql(""),
    "hwe_founders": _hwe_sql("WHERE founder"),
    "hwe_exact": _GS + """, n AS (SELECT vidx, count(*) FILTER (g = 0) n0, count(*) FILTER (g = 1) n1, count(*) FILTER (g = 2) n2 FROM c GROUP BY vidx), q AS (SELECT *, n0 + n1 + n2 n, 2 * least(n0, n2) + n1 r FROM n),
  l AS (SELECT vidx, n1, unnest(range(r % 2, r + 1, 2)) h, n, r FROM q), w AS (SELECT vidx, n1, h, h * ln(2) - lgamma(((r - h) // 2 + 1)::DOUBLE) - lgamma((h + 1)::DOUBLE) - lgamma((n - h - (r - h) // 2 + 1)::DOUBLE) lp FROM l),
  o AS (SELECT vidx, max(lp) FILTER (h = n1) seen FROM w GROUP BY vidx) SELECT w.vidx, least(1.0, sum(exp(lp - seen)) FILTER (lp <= seen + 1e-9) / sum(exp(lp - seen))) p_exact FROM w JOIN o USING (vidx) GROUP BY w.vidx""",
    "variant_missing": _W + " SELECT vidx, count(*) n_cells, count(*) FILTER (g IS NULL) n_missing, 1 - (count(*) FILTER (g IS NULL))::DOUBLE / count(*) call_rate FROM g GROUP BY vidx",
    "sample_counts": _W + ", n AS (SELECT iid, count(*) FILTER (g = 0) n0, count(*) FILTER (g = 1) n1, count(*) FILTER (g = 2) n2, count(*) FILTER (g IS NULL) n_missing FROM g GROUP BY iid) SELECT *, n1::DOUBLE / nullif(n0 + n2, 0) het_hom FROM n",
    "heterozygosity": _GS + """, q AS (SELECT vidx, sum(g)::DOUBLE a, count(*)::DOUBLE n FROM c GROUP BY vidx), e AS (SELECT vidx, 1 - 2 * (a / (2 * n)) * (1 - a / (2 * n)) * (2 * n / (2 * n - 1)) e FROM q JOIN v USING (vidx) WHERE a > 0 AND a < 2 * n AND chrom BETWEEN 1 AND 22),
  r AS (SELECT iid, count(*) FILTER (g <> 1) o_hom, sum(e) e_hom, count(*) n FROM c JOIN e USING (vidx) GROUP BY iid)
  SELECT iid, o_hom, e_hom, n, CASE WHEN abs(n - e_hom) > 1e-9 THEN (o_hom - e_hom) / (n - e_hom) END f FROM r""",
    "mendel_family": _mendel_sql("fid"),
    "mendel_sample": _mendel_sql("iid"),
    "mendel_variant": _mendel_sql("vidx"),
    "mendel_errors": _CELLS + " SELECT fid, iid, vidx, g_pat, g_mat, g FROM m WHERE error",
    "fst": _FST + " SELECT vidx, n_pop, num / nullif(den, 0) fst FROM w",
    "fst_gene": _FST + " SELECT gene, count(*) n_variant, sum(num) / nullif(sum(den), 0) fst FROM w JOIN gs USING (vidx) GROUP BY gene",
    "density": _W + """, b AS (SELECT chrom, pos // 10000000 bin, count(*) n FROM v WHERE pos IS NOT NULL AND chrom IS NOT NULL GROUP BY ALL), r AS (SELECT chrom, unnest(range(min(bin), max(bin) + 1)) bin FROM b GROUP BY chrom)
  SELECT r.chrom, r.bin, coalesce(n, 0) n_variant FROM r LEFT JOIN b ON b.chrom = r.chrom AND b.bin = r.bin""",
    "tstv": _W + f", t AS (SELECT chrom, count(*) FILTER (major || minor IN ('AG', 'GA', 'CT', 'TC')) n_ts, count(*) FILTER (major || minor NOT IN ('AG', 'GA', 'CT', 'TC')) n_tv FROM v WHERE {_SNV} AND chrom IS NOT NULL GROUP BY chrom) SELECT *, n_ts::DOUBLE / nullif(n_tv, 0) tstv FROM t",
    "rare_lists": _RARE + " SELECT * FROM rare",
    "family_unique": _unique_sql("fid"),
    "population_unique": _unique_sql("pop"),
    "variant_summary": _RARE + f""", x AS (SELECT v.*, kind, length(minor) - length(major) d FROM v LEFT JOIN rare USING (vidx) WHERE chrom IS NOT NULL)
  SELECT chrom, count(*) n_variant, min(pos) min_pos, max(pos) max_pos, count(*) FILTER ({_SNV}) n_snv, count(*) FILTER (kind = 'monomorphic') n_monomorphic, count(*) FILTER (kind = 'singleton') n_singleton, count(*) FILTER (kind = 'doubleton') n_doubleton,
  count(*) FILTER (d > 0) n_ins, max(d) FILTER (d > 0) max_ins, avg(d) FILTER (d > 0) avg_ins, count(*) FILTER (d < 0) n_del, max(-d) FILTER (d < 0) max_del, avg(-d) FILTER (d < 0) avg_del FROM x GROUP BY ROLLUP (chrom)""",
    "missing_traits": _W + " SELECT trait, iid FROM p WHERE val IS NULL AND iid IN (SELECT iid FROM s)",
    "missing_sex": _W + " SELECT fid, iid FROM s WHERE sex IS NULL OR sex NOT IN (1, 2)",
    "missing_by_status": _W + """ SELECT vidx, count(*) FILTER (g IS NULL AND val = 2) case_missing, count(*) FILTER (g IS NOT NULL AND val = 2) case_called, count(*) FILTER (g IS NULL AND val <> 2) control_missing, count(*) FILTER (g IS NOT NULL AND val <> 2) control_called
  FROM g JOIN p USING (iid) WHERE trait = 'ET' AND val IS NOT NULL GROUP BY vidx""",
    "top_variants": _FREQ + ", r AS (SELECT chrom, row_number() OVER (PARTITION BY chrom ORDER BY maf DESC, vidx) AS rank, vidx, maf FROM freq JOIN v USING (vidx) WHERE chrom IS NOT NULL) SELECT chrom, rank::INTEGER AS rank, vidx, maf FROM r WHERE rank <= 10",
    "sizes": _W + " SELECT 'samples' part, count(*) n FROM s UNION ALL SELECT 'variants', count(*) FROM v UNION ALL SELECT 'calls', count(*) FROM g UNION ALL SELECT 'traits', count(*) FROM p UNION ALL SELECT 'sets', count(*) FROM gs",
}
