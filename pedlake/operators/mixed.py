"""Mixed models over pedigrees, and logistic models with covariates.

With relationships from pedigrees the covariance is block diagonal, so each pedigree is rotated by its own
eigenvectors inside a task. After that a trait, its covariates and genotypes are independent rows with a known
eigenvalue d, and every likelihood is a sum over rows with weights 1 / (h2 d + 1 - h2): an aggregate. A grid of
h2 is taken in one pass and closes in on the best point. A pedigree of more than ``related.MOST_MEMBERS`` raises.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pedlake.functions import special
from pedlake.operators.assoc import CASE, CONTROL
from pedlake.operators.cohort import Cohort
from pedlake.operators.models import _singular, kinship
from pedlake.operators.related import MOST_MEMBERS, _task, pedigrees
from pedlake.plans.scratch import Scratch

GRID = np.linspace(0.0, 0.98, 50)


def _members(ped: pd.DataFrame) -> list[tuple]:
    text = lambda v: v if isinstance(v, str) else None
    return [(i, text(a), text(b)) for i, a, b in ped[["iid", "pat", "mat"]].itertuples(index=False)]


def _rotation(ped: pd.DataFrame, have: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues and vectors of twice the kinship of the listed members; those of a pedigree with a cycle count as unrelated."""
    if len(ped) > MOST_MEMBERS:
        raise ValueError(f"a pedigree of more than {MOST_MEMBERS} members")
    try:
        order, phi = kinship(_members(ped))
    except ValueError:
        return np.ones(len(have)), np.eye(len(have))
    at = {k: i for i, k in enumerate(order)}
    place = [at[i] for i in have]
    return np.linalg.eigh(phi[np.ix_(place, place)])


def _values(c: Cohort, trait: str, covariates: list[str]) -> tuple[DataFrame, list[str]]:
    y = c.trait(trait).withColumnRenamed("val", "y")
    for i, name in enumerate(covariates):
        y = y.join(c.trait(name).withColumnRenamed("val", f"x{i + 1}"), "iid")
    return y.withColumn("x0", F.lit(1.0)), [f"x{i}" for i in range(len(covariates) + 1)]


def rotated(c: Cohort, trait: str, covariates: list[str], ped: DataFrame | None = None) -> tuple[DataFrame, list[str]]:
    """(pedigree, d, y, x0..): rotated rows, one per sample with trait and covariates; and the names of x."""
    y, xs = _values(c, trait, covariates)
    rows = (pedigrees(c) if ped is None else ped).join(y, "iid", "left")

    def turn(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        for name, p in pdf.groupby("pedigree", sort=False):
            have = p[p["y"].notna()]
            if len(have):
                d, vec = _rotation(p, have["iid"].tolist())
                out.append(pd.DataFrame(vec.T @ have[["y", *xs]].to_numpy(float), columns=["y", *xs]).assign(pedigree=name, d=np.maximum(d, 0.0)))
        return pd.concat(out)[["pedigree", "d", "y", *xs]] if out else pd.DataFrame([], columns=["pedigree", "d", "y", *xs])

    return rows.groupBy(_task(c)).applyInPandas(turn, "pedigree string, d double, y double, " + ", ".join(f"{x} double" for x in xs)), xs


def _sums(rows: DataFrame, xs: list[str], grid: np.ndarray) -> list[dict]:
    """For each h2 of the grid: X'WX, X'Wy, y'Wy and the sum of log weights; and n."""
    cols = [*xs, "y"]
    k = len(cols)
    aggs = [F.count(F.lit(1)).alias("n")]
    for h in grid:
        w = F.col("d") * float(h) + float(1 - h)
        aggs += [F.sum(F.col(cols[i]) * F.col(cols[j]) / w) for i in range(k) for j in range(i, k)] + [F.sum(F.log(w))]
    row = list(rows.agg(*aggs).first())
    n, row, out = row[0], row[1:], []
    size = k * (k + 1) // 2 + 1
    for g, h in enumerate(grid):
        part = [v or 0.0 for v in row[g * size : (g + 1) * size]]
        m = np.zeros((k, k))
        for v, (i, j) in zip(part, ((i, j) for i in range(k) for j in range(i, k))):
            m[i, j] = m[j, i] = v
        out.append({"h": float(h), "n": n, "xx": m[:-1, :-1], "xy": m[:-1, -1], "yy": m[-1, -1], "logdet": part[-1]})
    return out


def _likelihood(s: dict, reml: bool) -> tuple[float, np.ndarray, float]:
    k = len(s["xy"])
    b = np.linalg.solve(s["xx"], s["xy"])
    rest = max(s["yy"] - b @ s["xy"], 1e-300)
    n = s["n"] - k if reml else s["n"]
    ll = -0.5 * (n * np.log(2 * np.pi * rest / n) + n + s["logdet"] + (np.linalg.slogdet(s["xx"])[1] if reml else 0.0))
    return float(ll), b, rest / n


def polygenic(c: Cohort, trait: str, covariates: list[str] | None = None, reml: bool = True, rows: DataFrame | None = None) -> DataFrame:
    """One row: h2, genetic and residual variance, log likelihood, number of samples and the fixed effects."""
    covariates = covariates or []
    spark = c.samples.sparkSession
    scratch = Scratch(spark, "polygenic")
    r, xs = rotated(c, trait, covariates) if rows is None else (rows, [f"x{i}" for i in range(len(covariates) + 1)])
    r = scratch.cut(r)
    schema = "h2 double, sig2g double, sig2 double, logl double, n long, effects map<string,double>"
    if scratch.rows <= len(xs):
        return spark.createDataFrame([], schema)
    lo, hi, best = 0.0, 0.999, None
    for _ in range(4):  # a pass each; the last grid is finer than 1e-4
        sums = _sums(r, xs, np.linspace(lo, hi, 21))
        fits = [_likelihood(s, reml) for s in sums]
        at = int(np.argmax([f[0] for f in fits]))
        best = (sums[at]["h"], *fits[at], sums[at]["n"])
        step = (hi - lo) / 20
        lo, hi = max(0.0, best[0] - step), min(0.999, best[0] + step)
    h2, ll, b, s2, n = best
    return spark.createDataFrame([(float(h2), float(h2 * s2), float((1 - h2) * s2), float(ll), n, {k: float(v) for k, v in zip(["intercept", *covariates], b)})], schema)


def mixed_scan(c: Cohort, trait: str, covariates: list[str] | None = None) -> DataFrame:
    """Per variant under y = X b + g beta + u + e with pedigree relationships: h2 of its own by REML and by ML over a grid of
    50, Wald F, likelihood ratio (1 df) and score F at the null fit. Missing genotypes are at the variant's mean.

    A task rotates the genotypes of whole pedigrees; per variant and task it sends sums for each h2 of the grid.
    """
    covariates = covariates or []
    spark = c.samples.sparkSession
    scratch = Scratch(spark, "scan")
    ped = pedigrees(c)
    r, xs = rotated(c, trait, covariates, ped)
    r = scratch.cut(r)
    k = len(xs)
    schema = "vidx long, n long, h2_reml double, h2_ml double, beta double, stat_wald double, p_wald double, stat_lrt double, p_lrt double, stat_score double, p_score double"
    if scratch.rows <= k + 1:
        return spark.createDataFrame([], schema)
    null = polygenic(c, trait, covariates, reml=False, rows=r).first()
    grid = np.append(GRID, null["h2"])
    base = _sums(r, xs, grid)
    l0 = _likelihood(base[-1], False)[0]
    y, _ = _values(c, trait, covariates)
    y = scratch.cut(y)
    n_all = scratch.rows
    mean = c.called().join(y.select("iid"), "iid", "left_semi").groupBy("vidx").agg(F.avg("g").alias("mean"), F.count(F.lit(1)).alias("n"))
    cells = c.called().join(y.select("iid"), "iid", "left_semi").join(mean, "vidx").select("iid", "vidx", (F.col("g") - F.col("mean")).alias("x")).where("x != 0")
    packed = cells.groupBy("iid").agg(F.collect_list("vidx").alias("v"), F.collect_list("x").alias("x"))  # a sample's calls
    rows = ped.join(y, "iid", "left").join(packed, "iid", "left")
    data = spark.sparkContext.broadcast(grid)

    def sums(pdf: pd.DataFrame) -> pd.DataFrame:
        h, out = data.value, {}
        for _, p in pdf.groupby("pedigree", sort=False):
            have = p[p["y"].notna()].reset_index(drop=True)
            if not len(have):
                continue
            d, vec = _rotation(p, have["iid"].tolist())
            some = [i for i, v in enumerate(have["v"]) if v is not None and len(v)]
            if not some:
                continue
            ids, at = np.unique(np.concatenate([have["v"][i] for i in some]), return_inverse=True)
            g = np.zeros((len(have), len(ids)))
            g[np.repeat(some, [len(have["v"][i]) for i in some]), at] = np.concatenate([have["x"][i] for i in some])
            g, z = vec.T @ g, vec.T @ have[["y", *xs]].to_numpy(float)
            w = 1 / (np.maximum(d, 0.0)[:, None] * h + 1 - h)  # members x grid
            parts = np.stack([(g * g).T @ w, *((g * z[:, [m]]).T @ w for m in range(k + 1))], 2)  # variants x grid x (gg, gy, gx)
            for v, part in zip(ids, parts):
                out[v] = out[v] + part if v in out else part
        return pd.DataFrame({"vidx": pd.Series(list(out), dtype="int64"), "s": pd.Series([a.ravel() for a in out.values()], dtype=object)})

    size = len(grid) * (k + 2)
    part = rows.groupBy(_task(c)).applyInPandas(sums, "vidx long, s array<double>")
    total = part.groupBy("vidx").agg(F.array(*(F.sum(F.get("s", F.lit(i))) for i in range(size))).alias("s")).join(mean.select("vidx", "n"), "vidx")

    def test(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            out = []
            for vidx, s, n in pdf.itertuples(index=False):
                s = np.asarray(s).reshape(len(grid), k + 2)
                gg, gy, gx = s[:, 0], s[:, 1], s[:, 2:]
                found = []
                for i, b in enumerate(base):
                    inv = np.linalg.inv(b["xx"])
                    pxx, pxy, pyy = gg[i] - gx[i] @ inv @ gx[i], gy[i] - gx[i] @ inv @ b["xy"], b["yy"] - b["xy"] @ inv @ b["xy"]
                    rest = max(pyy - pxy * pxy / pxx, 1e-300) if pxx > 1e-9 else np.nan
                    m, df = n_all, n_all - k - 1
                    ml = -0.5 * (m * np.log(2 * np.pi * rest / m) + m + b["logdet"])
                    reml = -0.5 * (df * np.log(2 * np.pi * rest / df) + df + b["logdet"] + np.linalg.slogdet(b["xx"])[1] + np.log(pxx)) if pxx > 1e-9 else np.nan
                    found.append((reml, ml, pxx, pxy, pyy, rest))
                if not np.isfinite(found[0][1]):
                    out.append((vidx, n, *(None,) * 9))
                    continue
                r, m = max(range(len(GRID)), key=lambda i: found[i][0]), max(range(len(grid)), key=lambda i: found[i][1])
                _, _, pxx, pxy, pyy, rest = found[r]
                wald = (pyy - rest) * df / rest
                lrt = max(0.0, 2 * (found[m][1] - l0))
                _, _, sxx, sxy, syy, _ = found[-1]
                score = n_all * sxy * sxy / (syy * sxx)
                out.append((vidx, n, float(grid[r]), float(grid[m]), pxy / pxx, wald, float(special.f_sf(wald, 1, df)), lrt, float(special.chi2_sf(lrt, 1)), score, float(special.f_sf(score, 1, df))))
            yield pd.DataFrame(out, columns=[x.split()[0] for x in schema.split(", ")])

    return total.select("vidx", "s", "n").mapInPandas(test, schema)


def variant_blup(c: Cohort, trait: str, ratio: float = 1.0) -> DataFrame:
    """u = (g - 2p)' inv(V) (y - mean) / sqrt(2p(1 - p)) per variant, with V = Phi + ratio I over pedigrees and the mean by least squares under V."""
    scratch = Scratch(c.samples.sparkSession, "blup")
    rows = pedigrees(c).join(c.trait(trait).withColumnRenamed("val", "y"), "iid", "left")

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        for _, p in pdf.groupby("pedigree", sort=False):
            have = p[p["y"].notna()]
            if len(have):
                d, vec = _rotation(p, have["iid"].tolist())
                inv = (vec / (np.maximum(d, 0.0) + ratio)) @ vec.T
                out.append(pd.DataFrame({"iid": have["iid"], "a": inv @ have["y"].to_numpy(float), "one": inv.sum(1)}))
        return pd.concat(out) if out else pd.DataFrame([], columns=["iid", "a", "one"])

    w = scratch.cut(rows.groupBy(_task(c)).applyInPandas(solve, "iid string, a double, one double"))
    t = w.agg(F.sum("a").alias("a"), F.sum("one").alias("one")).first()
    mean = (t["a"] or 0.0) / (t["one"] or 1.0)
    g = c.called().join(w.select("iid", (F.col("a") - mean * F.col("one")).alias("w")), "iid")
    m = g.groupBy("vidx").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("w") * F.col("g")).alias("wg"), F.sum("w").alias("w"), (F.avg("g") / 2).alias("p")).where("p > 0 and p < 1")
    return m.select("vidx", "n", ((F.col("wg") - 2 * F.col("p") * F.col("w")) / F.sqrt(2 * F.col("p") * (1 - F.col("p")))).alias("blup"))


def logistic_covariates(c: Cohort, trait: str, covariates: list[str], interaction: bool = False, rounds: int = 20, tolerance: float = 1e-6) -> DataFrame:
    """case ~ 1 + covariates + g [+ g x covariates] per variant: beta, Wald z and p of each term, and the steps taken.

    A Newton step of all variants is one aggregate of k (k + 3) / 2 sums per variant; variants that have settled take
    no part in the next. Covariates are scaled by their standard deviation inside. Those without a fit have null values
    and a reason: ``samples``, ``collinear`` or ``separation``.
    """
    spark = c.samples.sparkSession
    scratch = Scratch(spark, "logistic")
    y = c.trait(trait).where(F.col("val").isin(CASE, CONTROL)).select("iid", (F.col("val") == CASE).cast("double").alias("y"))
    for i, name in enumerate(covariates):
        y = y.join(c.trait(name).withColumnRenamed("val", f"c{i}"), "iid")
    y = scratch.cut(y)
    moments = y.agg(*(x for i in range(len(covariates)) for x in (F.avg(f"c{i}"), F.stddev_samp(f"c{i}"))) if covariates else [F.lit(0)]).first()
    scale = [(float(moments[2 * i] or 0.0), float(moments[2 * i + 1] or 0.0) or 1.0) for i in range(len(covariates))]
    y = y.select("iid", "y", *(((F.col(f"c{i}") - m) / s).alias(f"c{i}") for i, (m, s) in enumerate(scale)))
    x = [F.lit(1.0), *(F.col(f"c{i}") for i in range(len(covariates))), F.col("g").cast("double")]
    terms = ["intercept", *covariates, "g"]
    if interaction:
        x += [F.col("g") * F.col(f"c{i}") for i in range(len(covariates))]
        terms += [f"g:{n}" for n in covariates]
    k = len(x)
    cells = [(i, j) for i in range(k) for j in range(i, k)]
    t = scratch.cut(c.called().join(y, "iid").select("vidx", "y", *(v.alias(f"x{i}") for i, v in enumerate(x))))
    # from scaled to given covariates: b = T b', the same for covariance
    back = np.eye(k)
    for i, (m, s) in enumerate(scale):
        back[1 + i, 1 + i] = 1 / s
        back[0, 1 + i] = -m / s
        if interaction:
            back[2 + len(covariates) + i, 2 + len(covariates) + i] = 1 / s
            back[1 + len(covariates), 2 + len(covariates) + i] = -m / s
    state = scratch.cut(t.groupBy("vidx").agg(F.count(F.lit(1)).alias("n")).select("vidx", "n", F.array(*[F.lit(0.0)] * k).alias("b"), F.lit(0).alias("steps"), F.lit("live").alias("how"), F.array().cast("array<double>").alias("se")))
    schema = "vidx long, n long, b array<double>, steps int, how string, se array<double>"

    def step(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            out = []
            for vidx, n, b, steps, grad, hess in pdf.itertuples(index=False):
                h = np.zeros((k, k))
                for (i, j), v in zip(cells, hess):
                    h[i, j] = h[j, i] = v
                b, how, se = np.array(b), "live", []
                if n <= k:
                    how = "samples"
                elif _singular(h):
                    how = "separation" if steps else "collinear"
                else:
                    d = np.linalg.solve(h, grad)
                    b, steps = b + d, steps + 1
                    if np.abs(b).max() > 30:
                        how = "separation"
                    elif np.abs(d).sum() < tolerance:
                        how, se = "done", np.sqrt(np.diag(back @ np.linalg.inv(h) @ back.T))
                out.append((vidx, n, b, steps, how, se))
            yield pd.DataFrame(out, columns=["vidx", "n", "b", "steps", "how", "se"])

    settled = []
    for _ in range(rounds):
        live = t.join(state.where("how = 'live'").select("vidx", "n", "b", "steps"), "vidx")
        eta = sum(F.get("b", F.lit(i)) * F.col(f"x{i}") for i in range(k))
        live = live.withColumn("p", 1 / (1 + F.exp(-eta)))
        w = F.col("p") * (1 - F.col("p"))
        sums = live.groupBy("vidx").agg(F.first("n").alias("n"), F.first("b").alias("b"), F.first("steps").alias("steps"), F.array(*(F.sum((F.col("y") - F.col("p")) * F.col(f"x{i}")) for i in range(k))).alias("grad"), F.array(*(F.sum(w * F.col(f"x{i}") * F.col(f"x{j}")) for i, j in cells)).alias("hess"))
        state = scratch.cut(sums.mapInPandas(step, schema))
        if not scratch.rows:
            break
        settled.append(state.where("how != 'live'"))
    else:
        settled.append(state.where("how = 'live'").withColumn("how", F.lit("separation")))
    every = settled[0]
    for s in settled[1:]:
        every = every.unionByName(s)

    def report(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            out = []
            for vidx, n, b, steps, how, se in pdf.itertuples(index=False):
                if how != "done":
                    out += [(vidx, n, steps, name, None, None, None, how) for name in terms]
                    continue
                b = back @ np.array(b)
                z = b / np.array(se)
                out += [(vidx, n, steps, name, b[i], z[i], float(2 * special.norm_sf(abs(z[i]))), None) for i, name in enumerate(terms)]
            yield pd.DataFrame(out, columns=["vidx", "n", "n_iter", "term", "beta", "stat", "p_regr", "reason"])

    return every.mapInPandas(report, "vidx long, n long, n_iter int, term string, beta double, stat double, p_regr double, reason string")


def null_model(c: Cohort, trait: str, covariates: list[str]) -> DataFrame:
    """The linear model without a variant: each term's beta, t and p."""
    y = c.trait(trait).withColumnRenamed("val", "y")
    for i, name in enumerate(covariates):
        y = y.join(c.trait(name).withColumnRenamed("val", f"c{i}"), "iid")
    x = [F.lit(1.0), *(F.col(f"c{i}") for i in range(len(covariates)))]
    k = len(x)
    cells = [(i, j) for i in range(k) for j in range(i, k)]
    row = y.agg(F.count(F.lit(1)), F.sum(F.col("y") * F.col("y")), *(F.sum(v * F.col("y")) for v in x), *(F.sum(x[i] * x[j]) for i, j in cells)).first()
    spark, schema = c.samples.sparkSession, "term string, n long, beta double, stat double, p_regr double"
    n, yy = row[0], row[1] or 0.0
    m = np.zeros((k, k))
    for (i, j), v in zip(cells, row[2 + k :]):
        m[i, j] = m[j, i] = v or 0.0
    if n <= k or _singular(m):
        return spark.createDataFrame([], schema)
    inv, xy = np.linalg.inv(m), np.array([v or 0.0 for v in row[2 : 2 + k]])
    b = inv @ xy
    se = np.sqrt(max(0.0, yy - b @ xy) / (n - k) * np.diag(inv))
    return spark.createDataFrame([(name, n, float(v), float(v / s) if s else None, float(special.t_sf2(v / s, n - k)) if s else None) for name, v, s in zip(["intercept", *covariates], b, se)], schema)
