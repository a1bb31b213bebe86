"""Queries of pedigrees, relatives, gene sets and rare variants, and their SQL."""

from __future__ import annotations

from pedlake.operators import gene_tests, genes, pedigree
from pedlake.plans.association import BINARY, CONTINUOUS
from pedlake.plans.quality import _FREQ, _W, on_cohort

QUERIES = {
    "families": on_cohort(pedigree.families),
    "family_summary": on_cohort(pedigree.family_summary),
    "sibships": on_cohort(pedigree.sibships),
    "sibship_summary": on_cohort(pedigree.sibship_summary),
    "multi_mates": on_cohort(pedigree.multi_mates),
    "pair_counts": on_cohort(pedigree.pair_counts),
    "consanguineous": on_cohort(pedigree.consanguineous),
    "familial_correlation": on_cohort(lambda c: pedigree.familial_correlation(c, CONTINUOUS)),
    "trait_summary": on_cohort(pedigree.trait_summary),
    "ibs_relatives": on_cohort(pedigree.ibs_relatives),
    "grm_relatives": on_cohort(pedigree.grm_relatives),
    "gene_summary": on_cohort(genes.gene_summary),
    "consecutive_sets": on_cohort(lambda c: genes.consecutive_sets(c, 10, 3)),
    "near_genes": on_cohort(genes.near_genes),
    "annotated": on_cohort(genes.annotated),
    "collapsed": on_cohort(genes.collapsed),
    "burden_tests": on_cohort(lambda c: genes.burden_tests(c, BINARY)),
    "skat": on_cohort(lambda c: gene_tests.skat(c, BINARY)),
    "neighbours_ld": on_cohort(genes.neighbours_ld),
}

_L = _W + """, l AS (SELECT DISTINCT iid, parent FROM (SELECT iid, pat parent FROM s UNION ALL SELECT iid, mat FROM s) WHERE parent IS NOT NULL),
k AS (SELECT * FROM s WHERE pat IS NOT NULL AND mat IS NOT NULL)"""
_GENES = _W + ", ge AS (SELECT gene, chrom, count(*) n_variant, min(pos) AS start, max(pos) AS \"end\" FROM gs JOIN v USING (vidx) GROUP BY ALL)"
_NEAR = _GENES + """, near AS (SELECT v.vidx, gene, greatest(0, ge.start - v.pos, v.pos - ge."end")::INTEGER distance FROM v JOIN ge ON v.chrom = ge.chrom AND v.pos BETWEEN ge.start - 50000 AND ge."end" + 50000)"""
_COL = _FREQ + """, mm AS (SELECT c.vidx, c.iid, CASE WHEN flipped THEN 2 - c.g ELSE c.g END m, maf FROM c0 c JOIN freq USING (vidx)),
col AS (SELECT gene, iid, max((m > 0)::INT) carrier, sum(m * (1 - maf)**24) burden, sum(m)::BIGINT n_allele FROM mm JOIN gs USING (vidx) WHERE maf <= 0.05 AND maf > 0 GROUP BY ALL)"""
_COL = _COL.replace("c0 c", "(SELECT vidx, iid, g FROM g WHERE g IS NOT NULL) c")
_FC = _L + """, y AS (SELECT iid, val FROM p WHERE trait = 'AGE' AND val IS NOT NULL),
po AS (SELECT a.val x, b.val y FROM l JOIN y a ON a.iid = l.iid JOIN y b ON b.iid = l.parent),
sb AS (SELECT a.val x, b.val y FROM k k1 JOIN k k2 ON k1.pat = k2.pat AND k1.mat = k2.mat AND k1.iid <> k2.iid JOIN y a ON a.iid = k1.iid JOIN y b ON b.iid = k2.iid)"""

SQL = {
    "families": _W + " SELECT fid, count(*) n_member, count(*) FILTER (founder) n_founder, count(*) FILTER (NOT founder) n_nonfounder, count(*) FILTER (sex = 1) n_male, count(*) FILTER (sex = 2) n_female, 2 * count(*) FILTER (NOT founder) - count(*) FILTER (founder) inheritance_bits FROM s WHERE fid IS NOT NULL GROUP BY fid",
    "family_summary": _W + ", f AS (SELECT count(*) n FROM s WHERE fid IS NOT NULL GROUP BY fid) SELECT count(*) n_family, avg(n) mean_size, CASE WHEN count(*) > 1 THEN stddev_pop(n) END sd_size, min(n) min_size, max(n) max_size FROM f",
    "sibships": _L + " SELECT pat, mat, count(*) n, count(*) FILTER (sex = 1) n_male, count(*) FILTER (sex = 2) n_female FROM k GROUP BY ALL",
    "sibship_summary": _L + ", f AS (SELECT count(*) n FROM k GROUP BY pat, mat) SELECT count(*) n_sibship, avg(n) mean_size, CASE WHEN count(*) > 1 THEN stddev_pop(n) END sd_size, min(n) min_size, max(n) max_size FROM f",
    "multi_mates": _L + ", m AS (SELECT DISTINCT pat, mat FROM k), b AS (SELECT pat iid, mat mate FROM m UNION ALL SELECT mat, pat FROM m) SELECT iid, count(*) n_mate FROM b GROUP BY iid HAVING count(*) > 1",
    "pair_counts": _L + """, sib AS (SELECT a.iid i, b.iid j, a.sex si, b.sex sj FROM k a JOIN k b ON a.pat = b.pat AND a.mat = b.mat AND a.iid < b.iid),
  bp AS (SELECT a.iid i, b.iid j FROM (SELECT iid, unnest([pat, mat]) p FROM k) a JOIN (SELECT iid, unnest([pat, mat]) p FROM k) b ON a.p = b.p AND a.iid < b.iid)
  SELECT 'parent_offspring' relation, count(*) n_pair FROM l UNION ALL SELECT 'sib', count(*) FROM sib UNION ALL SELECT 'sister_sister', count(*) FROM sib WHERE si = 2 AND sj = 2 UNION ALL SELECT 'brother_brother', count(*) FROM sib WHERE si = 1 AND sj = 1
  UNION ALL SELECT 'brother_sister', count(*) FROM sib WHERE (si = 1 AND sj = 2) OR (si = 2 AND sj = 1) UNION ALL SELECT 'grandparent', count(*) FROM l a JOIN l b ON a.parent = b.iid
  UNION ALL SELECT 'avuncular', count(*) FROM l JOIN (SELECT i, j FROM sib UNION ALL SELECT j, i FROM sib) q ON l.parent = q.i
  UNION ALL SELECT 'half_sib', (SELECT count(*) FROM bp) - 2 * (SELECT count(*) FROM sib) UNION ALL SELECT 'cousin', count(*) FROM l a JOIN sib ON sib.i = a.parent JOIN l b ON b.parent = sib.j""",
    "consanguineous": _L + """, m AS (SELECT DISTINCT pat, mat FROM k), x AS (SELECT DISTINCT unnest([pat, mat]) iid FROM m),
  u AS (SELECT iid, iid top, 0 d FROM x UNION SELECT x.iid, l.parent, 1 FROM x JOIN l ON l.iid = x.iid UNION SELECT x.iid, b.parent, 2 FROM x JOIN l a ON a.iid = x.iid JOIN l b ON b.iid = a.parent)
  SELECT m.pat, m.mat, min(a.d + b.d) distance FROM m JOIN u a ON a.iid = m.pat JOIN u b ON b.iid = m.mat AND a.top = b.top GROUP BY ALL""",
    "familial_correlation": _FC + " SELECT 'parent_offspring' relation, count(*) n_pair, CASE WHEN count(*) > 2 THEN corr(x, y) END r FROM po UNION ALL SELECT 'sib', count(*) // 2, CASE WHEN count(*) > 4 THEN corr(x, y) END FROM sb",
    "trait_summary": _W + " SELECT trait, sex, founder, count(*) n, avg(val) mean, stddev_samp(val) sd FROM p JOIN s USING (iid) WHERE val IS NOT NULL GROUP BY ALL",
    "ibs_relatives": _L + " SELECT l.iid, l.parent, count(*) n, avg(1 - abs(a.g - b.g) / 2.0::DOUBLE) ibs, avg((a.g <> b.g)::INT) hamming FROM l JOIN g a ON a.iid = l.iid JOIN g b ON b.iid = l.parent AND a.vidx = b.vidx WHERE a.g IS NOT NULL AND b.g IS NOT NULL GROUP BY ALL",
    "grm_relatives": _L + """, f AS (SELECT vidx, avg(g) / 2 q FROM g WHERE g IS NOT NULL GROUP BY vidx HAVING avg(g) > 0 AND avg(g) < 2), z AS (SELECT vidx, iid, (g - 2 * q) / sqrt(2 * q * (1 - q)) x FROM g JOIN f USING (vidx) WHERE g IS NOT NULL)
  SELECT l.iid, l.parent, count(*) n, avg(a.x * b.x) grm FROM l JOIN z a ON a.iid = l.iid JOIN z b ON b.iid = l.parent AND a.vidx = b.vidx GROUP BY ALL""",
    "gene_summary": _GENES + " SELECT * FROM ge",
    "consecutive_sets": _W + """, o AS (SELECT chrom, vidx, row_number() OVER (PARTITION BY chrom ORDER BY pos, vidx) - 1 i FROM v WHERE chrom IS NOT NULL AND pos IS NOT NULL)
  SELECT chrom, unnest(range(greatest(0, ceil((i - 9) / 7.0::DOUBLE))::BIGINT, i // 7 + 1))::INTEGER set_no, vidx FROM o""",
    "near_genes": _NEAR + " SELECT * FROM near",
    "annotated": _NEAR + ", t AS (SELECT vidx, array_to_string(list_sort(list(CASE WHEN distance = 0 THEN gene ELSE gene || '(' || distance || ')' END)), ',') genes FROM near GROUP BY vidx) SELECT v.vidx, genes FROM v LEFT JOIN t USING (vidx)",
    "collapsed": _COL + " SELECT * FROM col",
    "burden_tests": _COL + f""", y AS (SELECT iid, val FROM p WHERE trait = '{BINARY}' AND val IS NOT NULL), t AS (SELECT col.*, val - (SELECT avg(val) FROM y) w FROM col JOIN y USING (iid)),
  m AS (SELECT gene, count(*) n, sum(n_allele)::BIGINT mac, sum(w) sw, sum(w*w) ww, sum(carrier)::DOUBLE s1, sum(carrier*carrier)::DOUBLE ss1, sum(carrier*w) w1, sum(burden) s2, sum(burden*burden) ss2, sum(burden*w) w2 FROM t GROUP BY gene),
  q AS (SELECT *, (ss1 - s1*s1/n) * (ww - sw*sw/n) / n v1, (ss2 - s2*s2/n) * (ww - sw*sw/n) / n v2 FROM m)
  SELECT gene, n, mac, CASE WHEN v1 > 1e-12 THEN (w1 - s1*sw/n)**2 / v1 END stat_cmc, CASE WHEN v2 > 1e-12 THEN (w2 - s2*sw/n)**2 / v2 END stat_clp FROM q""",
    "neighbours_ld": _W + """, o AS (SELECT chrom, vidx, row_number() OVER (PARTITION BY chrom ORDER BY pos, vidx) i FROM v WHERE chrom IS NOT NULL AND pos IS NOT NULL), pr AS (SELECT a.vidx vidx1, b.vidx vidx2 FROM o a JOIN o b ON a.chrom = b.chrom AND b.i IN (a.i + 1, a.i + 2)),
  m AS (SELECT vidx1, vidx2, count(*) n, sum(a.g)::DOUBLE sx, sum(b.g)::DOUBLE sy, sum(a.g*a.g)::DOUBLE sxx, sum(b.g*b.g)::DOUBLE syy, sum(a.g*b.g)::DOUBLE sxy FROM pr JOIN g a ON a.vidx = vidx1 JOIN g b ON b.vidx = vidx2 AND a.iid = b.iid WHERE a.g IS NOT NULL AND b.g IS NOT NULL GROUP BY ALL),
  r AS (SELECT vidx1, vidx2, n, CASE WHEN n*sxx - sx*sx > 0 AND n*syy - sy*sy > 0 THEN (n*sxy - sx*sy) / sqrt((n*sxx - sx*sx) * (n*syy - sy*sy)) END r FROM m) SELECT *, r * r r2 FROM r""",
}
