"""Queries of association tests, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from pedlake.operators import assoc
from pedlake.plans.quality import _FREQ, _GS, _W, on_cohort

BINARY, CONTINUOUS = "ET", "AGE"

QUERIES = {
    "case_counts": on_cohort(lambda c: assoc.case_counts(c, BINARY)),
    "fisher_tables": on_cohort(lambda c: assoc.carrier_tables(c, BINARY)),
    "fisher_p": on_cohort(lambda c: assoc.fisher(c, BINARY).select("vidx", "p_fisher")),
    "trend": on_cohort(lambda c: assoc.trend(c, BINARY)),
    "trend_p": on_cohort(lambda c: assoc.trend_test(c, BINARY).select("vidx", "p_trend", "p_abt", "p_geno2df")),
    "linear": on_cohort(lambda c: assoc.linear(c, CONTINUOUS)),
    "linear_weighted": on_cohort(lambda c: assoc.linear(c, CONTINUOUS, True).select("vidx", "n", "beta")),
    "linear_p": on_cohort(lambda c: assoc.linear_test(c, CONTINUOUS).select("vidx", "p_regr")),
    "qls": on_cohort(lambda c: assoc.qls(c, CONTINUOUS)),
    "qls_p": on_cohort(lambda c: assoc.qls_test(c, CONTINUOUS).select("vidx", "p_qls")),
    "tdt": on_cohort(lambda c: assoc.tdt(c, BINARY)),
    "tdt_p": on_cohort(lambda c: assoc.tdt_test(c, BINARY).select("vidx", "p_tdt")),
    "adjust": on_cohort(lambda c: assoc.adjust(assoc.trend_test(c, BINARY).select("vidx", F.col("p_trend").alias("p")))),
    "genomic_control": on_cohort(lambda c: assoc.genomic_control(assoc.trend(c, BINARY), "stat_trend")),
    "quick_epistasis": on_cohort(lambda c: assoc.quick_epistasis(c, BINARY)),
    "mdr_gene": on_cohort(lambda c: assoc.mdr(c, BINARY)),
    "blue_freq": on_cohort(assoc.blue_freq),
    "genetic_models": on_cohort(assoc.model_counts),
    "variant_weights": on_cohort(assoc.weighted_mean_freq),
}

_Y = f", y AS (SELECT iid, val FROM p WHERE trait = '{BINARY}' AND val IN (1, 2)), q AS (SELECT iid, val FROM p WHERE trait = '{CONTINUOUS}' AND val IS NOT NULL)"
_N = _W + _Y + ", n AS (SELECT vidx, " + ", ".join(f"count(*) FILTER (val = {v} AND g = {k}) {x}{k}" for x, v in (("a", 2), ("u", 1)) for k in (0, 1, 2)) + " FROM g JOIN y USING (iid) WHERE g IS NOT NULL GROUP BY vidx)"
_TREND = _N + """, x AS (SELECT vidx, a0::DOUBLE a0, a1::DOUBLE a1, a2::DOUBLE a2, u0::DOUBLE u0, u1::DOUBLE u1, u2::DOUBLE u2, (a0+a1+a2)::DOUBLE n1, (u0+u1+u2)::DOUBLE n0, (a0+u0)::DOUBLE c0, (a1+u1)::DOUBLE c1, (a2+u2)::DOUBLE c2 FROM n),
z AS (SELECT *, n1 + n0 n, (c1 + 2*c2) / nullif(n1 + n0, 0) mean, n0 / nullif(n1 + n0, 0) phi FROM x),
r AS (SELECT vidx, (u0*(0-mean) + u1*(1-mean) + u2*(2-mean))**2 / nullif(phi*(1-phi)*(c0*(0-mean)**2 + c1*(1-mean)**2 + c2*(2-mean)**2), 0) stat_trend,
  ((a1+2*a2)/nullif(2*n1,0) - (u1+2*u2)/nullif(2*n0,0))**2 / nullif(((c1+2*c2)/nullif(2*n,0))*(1-(c1+2*c2)/nullif(2*n,0))*(1/nullif(2*n1,0)+1/nullif(2*n0,0)), 0) stat_abt,
  """ + " + ".join(f"({x}{k} - {m}*c{k}/n)**2 / nullif({m}*c{k}/n, 0)" for x, m in (("a", "n1"), ("u", "n0")) for k in (0, 1, 2)) + " stat_geno FROM z)"


# tails of distributions by Simpson's rule, with relative precision
_SIMPSON = "(CASE WHEN i = 0 OR i = 4000 THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END)"


def p_normal(z: str) -> str:
    """SQL of the two-sided normal p-value: density times the integral of exp(-z t - t^2 / 2)."""
    return f"CASE WHEN ({z}) IS NOT NULL THEN least(1.0, 2 * exp(0 - ({z})**2 / 2) / sqrt(2 * pi()) * list_sum(list_transform(range(0, 4001), lambda i: {_SIMPSON} * exp(-abs({z}) * i * 0.003 - (i * 0.003)**2 / 2))) * 0.001) END"


def p_student(t: str, df: str) -> str:
    """SQL of the two-sided p-value of Student's t: the integral of a power of the cosine."""
    a = f"atan(abs({t}) / sqrt(({df})::DOUBLE))"
    return f"2 * exp(lgamma((({df}) + 1) / 2.0::DOUBLE) - lgamma(({df}) / 2.0::DOUBLE)) / sqrt(pi()) * list_sum(list_transform(range(0, 4001), lambda i: {_SIMPSON} * greatest(cos({a} + (pi() / 2 - {a}) * i / 4000), 0)**(({df}) - 1))) * (pi() / 2 - {a}) / 12000"


def p_fisher(a: str, b: str, c: str, d: str) -> str:
    """SQL of Fisher's two-sided p: all tables with the margins that are as likely or less."""
    log = lambda x: f"-(lgamma({x} + 1) + lgamma({a} + {b} - {x} + 1) + lgamma({a} + {c} - {x} + 1) + lgamma({d} - {a} + {x} + 1))"
    tables = f"range(greatest(0, {a} - {d}), least({a} + {b}, {a} + {c}) + 1)"
    return f"CASE WHEN {a} + {b} + {c} + {d} > 0 THEN least(1.0, list_sum(list_transform({tables}, lambda x: CASE WHEN {log('x')} <= {log(a)} + 1e-9 THEN exp({log('x')} - ({log(a)})) ELSE 0 END)) / list_sum(list_transform({tables}, lambda x: exp({log('x')} - ({log(a)}))))) END"


def _linear(w: str, join: str) -> str:
    return _W + _Y + f""", m AS (SELECT vidx, count(*) n, sum({w}) w, sum({w}*g) sx, sum({w}*val) sy, sum({w}*g*g) sxx, sum({w}*g*val) sxy, sum({w}*val*val) syy FROM g JOIN q USING (iid) {join} WHERE g IS NOT NULL GROUP BY vidx),
  k AS (SELECT vidx, n, sxx - sx*sx/w xx, sxy - sx*sy/w xy, syy - sy*sy/w yy FROM m), b AS (SELECT *, CASE WHEN n > 2 AND xx > 1e-9 THEN xy / xx END beta FROM k),
  o AS (SELECT vidx, n, beta, sqrt(greatest(yy - beta*xy, 0) / nullif(n - 2, 0) / xx) se FROM b)"""


_ADJ = _TREND + f""", pv AS (SELECT vidx, {p_normal('sqrt(stat_trend)')} p FROM r WHERE stat_trend IS NOT NULL), rk AS (SELECT *, row_number() OVER (ORDER BY p, vidx) rank, count(*) OVER () m FROM pv),
  ad AS (SELECT *, least(p * m, 1) bonferroni, 1 - (1 - p)**m sidak_ss, greatest(max((m - rank + 1) * p) OVER u, 0) h, max(1 - (1 - p)**(m - rank + 1)) OVER u sidak_sd, min(m * p / rank) OVER (ORDER BY rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) b FROM rk WINDOW u AS (ORDER BY rank ROWS UNBOUNDED PRECEDING))"""

SQL = {
    "fisher_p": _N + f", t AS (SELECT vidx, (a1 + a2)::DOUBLE a, a0::DOUBLE b, (u1 + u2)::DOUBLE c, u0::DOUBLE d FROM n) SELECT vidx, {p_fisher('a', 'b', 'c', 'd')} p_fisher FROM t".replace("range(greatest(0, a - d), least(a + b, a + c) + 1)", "range(greatest(0, a - d)::BIGINT, (least(a + b, a + c) + 1)::BIGINT)"),
    "trend_p": _TREND + f" SELECT vidx, {p_normal('sqrt(stat_trend)')} p_trend, {p_normal('sqrt(stat_abt)')} p_abt, exp(-stat_geno / 2) p_geno2df FROM r",
    "adjust": _ADJ + " SELECT vidx, p, rank, bonferroni, least(h, 1) holm, sidak_ss, sidak_sd, least(b, 1) bh, least(b * (SELECT sum(1.0::DOUBLE / i) FROM range(1, (SELECT count(*) + 1 FROM pv)) t(i)), 1) \"by\" FROM ad",
    "variant_weights": _FREQ + " SELECT vidx, maf, 25 * (1 - maf)**24 weight FROM freq",
    "case_counts": _N + " SELECT * FROM n",
    "fisher_tables": _N + " SELECT vidx, a1 + a2 case_carrier, a0 case_other, u1 + u2 control_carrier, u0 control_other FROM n",
    "trend": _TREND + " SELECT * FROM r",
    "linear": _linear("1.0::DOUBLE", "") + " SELECT vidx, n, beta, CASE WHEN beta IS NOT NULL THEN se END se, beta / nullif(se, 0) stat FROM o",
    "linear_weighted": _linear("weight", "JOIN s ON s.iid = g.iid AND s.weight > 0") + " SELECT vidx, n, beta FROM o",
    "qls": _W + _Y + """, a AS (SELECT vidx, g::DOUBLE g, val - (SELECT avg(val) FROM q) w FROM g JOIN q USING (iid) WHERE g IS NOT NULL), m AS (SELECT vidx, count(*) n, avg(g) gm, sum(w*g) wg, sum(w) sw, sum(w*w) ww FROM a GROUP BY vidx),
  k AS (SELECT *, 2*(gm/2)*(1-gm/2)*(ww - sw*sw/n) var FROM m) SELECT vidx, n, (wg - sw*gm) / sqrt(CASE WHEN var > 1e-12 THEN var END) stat FROM k""",
    "tdt": _W + _Y + """, t AS (SELECT k.vidx, k.g child, a.g pa, b.g ma FROM g k JOIN s ON s.iid = k.iid JOIN g a ON a.vidx = k.vidx AND a.iid = s.pat JOIN g b ON b.vidx = k.vidx AND b.iid = s.mat JOIN y ON y.iid = k.iid AND y.val = 2 WHERE k.g IS NOT NULL AND a.g IS NOT NULL AND b.g IS NOT NULL),
  h AS (SELECT vidx, (pa = 1)::INT + (ma = 1)::INT het, child - (pa = 2)::INT - (ma = 2)::INT got FROM t), r AS (SELECT vidx, sum(got)::BIGINT n_transmitted, sum(het - got)::BIGINT n_not FROM h WHERE het > 0 AND got BETWEEN 0 AND het GROUP BY vidx)
  SELECT *, (n_transmitted - n_not)::DOUBLE**2 / nullif(n_transmitted + n_not, 0) stat_tdt FROM r""",
    "genomic_control": _TREND + " SELECT greatest(median(stat_trend) / 0.456::DOUBLE, 1) \"lambda\", count(stat_trend) n FROM r",
    "quick_epistasis": _W + _Y + """, k AS (SELECT gene, vidx, iid, g, val = 2 c FROM g JOIN gs USING (vidx) JOIN y USING (iid) WHERE g IS NOT NULL), t AS (SELECT a.gene, a.vidx vidx1, b.vidx vidx2, a.c, a.g g1, b.g g2 FROM k a JOIN k b ON a.gene = b.gene AND a.iid = b.iid AND a.vidx < b.vidx),
  m AS (SELECT gene, vidx1, vidx2, """ + ", ".join(f"coalesce(sum({e}) FILTER ({f}), 0)::BIGINT {s}_{n}" for s, f in (("a", "c"), ("u", "NOT c")) for n, e in (("11", "g1*g2"), ("10", "g1*(2-g2)"), ("01", "(2-g1)*g2"), ("00", "(2-g1)*(2-g2)"))) + """ FROM t GROUP BY ALL)
  SELECT *, CASE WHEN least(a_11, a_10, a_01, a_00, u_11, u_10, u_01, u_00) > 0 THEN abs(ln(a_11::DOUBLE * a_00 / (a_10::DOUBLE * a_01)) - ln(u_11::DOUBLE * u_00 / (u_10::DOUBLE * u_01))) / sqrt(1.0::DOUBLE/a_11 + 1.0::DOUBLE/a_10 + 1.0::DOUBLE/a_01 + 1.0::DOUBLE/a_00 + 1.0::DOUBLE/u_11 + 1.0::DOUBLE/u_10 + 1.0::DOUBLE/u_01 + 1.0::DOUBLE/u_00) END z FROM m""",
    "mdr_gene": _W + _Y + """, k AS (SELECT gene, vidx, iid, g, val = 2 c FROM g JOIN gs USING (vidx) JOIN y USING (iid) WHERE g IS NOT NULL), t AS (SELECT a.gene, a.vidx vidx1, b.vidx vidx2, a.g g1, b.g g2, count(*) FILTER (a.c) x, count(*) FILTER (NOT a.c) w FROM k a JOIN k b ON a.gene = b.gene AND a.iid = b.iid AND a.vidx < b.vidx GROUP BY ALL),
  m AS (SELECT gene, vidx1, vidx2, sum(x + w)::BIGINT n, sum(greatest(x, w))::BIGINT n_right FROM t GROUP BY ALL) SELECT *, n_right::DOUBLE / n score FROM m ORDER BY score DESC, n DESC, gene, vidx1, vidx2 LIMIT 20""",
    "blue_freq": _W + " SELECT vidx, sum(weight * g) / sum(weight) / 2 p_weighted, count(*) n FROM g JOIN s USING (iid) WHERE g IS NOT NULL AND weight IS NOT NULL GROUP BY vidx",
    "genetic_models": _W + " SELECT vidx, avg(g) additive, avg((g > 0)::INT) dominant, avg((g = 2)::INT) recessive, avg(g * g) multiplicative FROM g WHERE g IS NOT NULL GROUP BY vidx",
}
SQL |= {
    "linear_p": SQL["linear"].replace("SELECT vidx, n, beta, CASE", ", q2 AS (SELECT vidx, n, beta, CASE", 1) + f") SELECT vidx, CASE WHEN stat IS NOT NULL THEN {p_student('stat', 'n - 2')} END p_regr FROM q2",
    "qls_p": "WITH b AS (" + SQL["qls"] + f") SELECT vidx, {p_normal('stat')} p_qls FROM b",
    "tdt_p": "WITH b AS (" + SQL["tdt"] + f") SELECT vidx, {p_normal('sqrt(stat_tdt)')} p_tdt FROM b",
}
