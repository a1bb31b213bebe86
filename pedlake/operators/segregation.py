"""Segregation of a continuous trait in pedigrees: is there a major gene, and is it transmitted as Mendel says?

A person's type is a pair of factors of two kinds; types have means of their own and a common deviation. The likelihood of a
pedigree is a sum over types, eliminated one by one for many candidate parameters at once, so a round of the
search is one pass over pedigrees. Candidates of the next round are drawn around the best so far and ever closer.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pedlake.operators.cohort import Cohort
from pedlake.operators.linkage_models import WIDEST
from pedlake.operators.related import _task, pedigrees
from pedlake.plans.scratch import Scratch

#: Parameters searched of each model: q is the frequency of the factor that raises the trait, t0..t2 the probabilities that a
#: person of type 0, 1, 2 passes it on.
MODELS = {"one_mean": ("m0", "sd"), "no_transmission": ("q", "m0", "m1", "m2", "sd"), "mendelian": ("q", "m0", "m1", "m2", "sd"), "general": ("q", "t0", "t1", "t2", "m0", "m1", "m2", "sd")}
CANDIDATES, ROUNDS = 96, 14
#: Candidates x members of pedigrees of one form that are held at once.
TOGETHER = 200_000


def type_likelihoods(members: list[tuple[str, str | None, str | None]], density: np.ndarray, q: np.ndarray, tau: np.ndarray) -> np.ndarray:
    """Log likelihoods of one pedigree whose parents all are members, for B candidates. density: B x members x 3; q: B; tau: B x 3."""
    b, at = len(q), {k: i for i, (k, _, _) in enumerate(members)}
    shape = tuple((-1 if pat is None else at[pat], -1 if mat is None else at[mat]) for _, pat, mat in members)
    prior = np.stack([1 - q, q], 1)
    sent = np.stack([np.stack([np.stack([1 - tau[:, x + y], tau[:, x + y]], 1) for y in range(2)], 1) for x in range(2)], 1)  # B x 2 x 2 x 2
    types = np.array([[0, 1], [1, 2]])
    held = [f for i, pair in enumerate(shape) for f in (density[:, i][:, types], *(prior if p < 0 else sent for p in pair))]
    total = np.zeros(b)
    for use, spec, kept in elimination(shape):
        got = np.einsum(spec, *(held[k] for k in use))
        size = got.reshape(b, -1).max(1)
        with np.errstate(divide="ignore", invalid="ignore"):
            total = total + np.log(size)
            got = got / np.where(size > 0, size, 1.0).reshape(b, *[1] * kept)
        for k in use:
            held[k] = None
        held.append(got)
    return total


@lru_cache(4096)
def elimination(shape: tuple[tuple[int, int], ...]) -> list[tuple[list[int], str, int]]:
    """Steps that sum a pedigree's factors out, those with the fewest neighbours first: places of the tables multiplied, how, and
    how many factors are left in the new table, which is put at the end. shape: each member's parents' places, -1 for none."""
    tables: list[tuple[int, ...]] = []
    for i, pair in enumerate(shape):
        tables.append((2 * i, 2 * i + 1))
        tables += [(2 * i + k,) if p < 0 else (2 * p, 2 * p + 1, 2 * i + k) for k, p in enumerate(pair)]
    of: dict[int, set[int]] = {v: set() for v in range(2 * len(shape))}
    for k, vs in enumerate(tables):
        for v in vs:
            of[v].add(k)
    met = {v: set().union(*(tables[k] for k in ks)) for v, ks in of.items()}
    left, steps = sorted(of), []
    while left:
        v = min(left, key=lambda x: len(met[x]))
        if len(met[v]) > 2 * WIDEST:
            raise ValueError("too many loops in a pedigree")
        names = {x: chr(98 + k) for k, x in enumerate(sorted(met[v]))}
        use, keep = sorted(of[v]), tuple(sorted(met[v] - {v}))
        steps.append((use, ",".join("a" + "".join(names[x] for x in tables[k]) for k in use) + "->a" + "".join(names[x] for x in keep), len(keep)))
        for k in use:
            for x in tables[k]:
                of[x].discard(k)
        tables.append(keep)
        for x in keep:
            of[x].add(len(tables) - 1)
        for x in keep:
            met[x] = set().union(*(tables[k] for k in of[x]))
        left.remove(v)
    return steps


def _ordered(members: dict[str, tuple[str | None, str | None]]) -> list[str]:
    """Members so that pedigrees of one form mostly come out alike: fathers, mothers and other founders, then children by their parents."""
    pats, mats = ({p[k] for p in members.values()} for k in range(2))
    order = sorted((k for k, p in members.items() if p == (None, None)), key=lambda k: (k not in pats, k not in mats, k))
    place, rest = {k: i for i, k in enumerate(order)}, [k for k, p in members.items() if p != (None, None)]
    while rest:
        ready = [k for k in rest if all(p is None or p in place for p in members[k])]
        if not ready:  # a cycle
            ready = rest
        ready.sort(key=lambda k: ([place.get(p, -1) for p in members[k]], k not in pats, k not in mats, k))
        for k in ready:
            place[k] = len(place)
        order += ready
        rest = [k for k in rest if k not in place]
    return order


def _slices(pdf: pd.DataFrame):
    """Arrays of iid, pat, mat and val of each pedigree of a task."""
    code = pd.factorize(pdf["pedigree"])[0]
    order = np.argsort(code, kind="stable")
    cols = [pdf[k].to_numpy()[order] for k in ("iid", "pat", "mat", "val")]
    ends = np.cumsum(np.bincount(code))
    for lo, hi in zip([0, *ends[:-1]], ends):
        yield lo, [x[lo:hi] for x in cols[:3]] + [cols[3][lo:hi].astype(float)]


def _expand(model: str, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """q, tau, means and deviation of candidates in the order of the model's parameters."""
    p = dict(zip(MODELS[model], x.T))
    n = len(x)
    q = p.get("q", np.full(n, 0.5))
    tau = np.stack([p["t0"], p["t1"], p["t2"]], 1) if model == "general" else np.tile([0.0, 0.5, 1.0], (n, 1)) if model == "mendelian" else np.tile(q[:, None], (1, 3))
    means = np.stack([p["m0"], p.get("m1", p["m0"]), p.get("m2", p["m0"])], 1)
    return q, tau, means, p["sd"]


def segregation(c: Cohort, trait: str, models: tuple[str, ...] = ("one_mean", "no_transmission", "mendelian", "general"), seed: int = 1) -> DataFrame:
    """Per model its greatest log likelihood, AIC, number of parameters, and the parameters. Members without the trait count as parents only."""
    spark = c.samples.sparkSession
    scratch = Scratch(spark, "segregation")
    y = c.trait(trait)
    rows = scratch.cut(pedigrees(c).join(y, "iid", "left"))
    t = y.agg(F.avg("val").alias("m"), F.stddev_samp("val").alias("s"), F.count(F.lit(1)).alias("n")).first()
    schema = "model string, logl double, aic double, n_parameter int, parameters map<string,double>"
    if not t["n"] or not t["s"]:
        return spark.createDataFrame([], schema)
    centre, width = t["m"], t["s"]
    low = {"q": 0.01, "sd": 0.2 * width, **{f"t{k}": 0.0 for k in range(3)}, **{f"m{k}": centre - 2.5 * width for k in range(3)}}
    high = {"q": 0.99, "sd": 1.5 * width, **{f"t{k}": 1.0 for k in range(3)}, **{f"m{k}": centre + 2.5 * width for k in range(3)}}
    task = rows.withColumn("task", _task(c))

    def evaluate(sets: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
        parts = [_expand(m, x) for m, x in sets.items()]
        q, tau, means, sd = (np.concatenate([p[k] for p in parts]) for k in range(4))

        def score(pdf: pd.DataFrame) -> pd.DataFrame:
            total = np.zeros(len(q))
            alike: dict[tuple, list] = {}  # pedigrees of one form are summed together
            pdf = pdf.astype({k: object for k in ("iid", "pat", "mat")})
            for _, p in _slices(pdf):
                iids, pats, mats, vals = p
                if np.isnan(vals).all():
                    continue
                text = lambda v: v if isinstance(v, str) else None
                members = {i: (text(a), text(b)) for i, a, b in zip(iids, pats, mats)}
                for pair in list(members.values()):
                    for x in pair:
                        if x is not None:
                            members.setdefault(x, (None, None))
                order = _ordered(members)
                at = {k: i for i, k in enumerate(order)}
                y = np.full(len(order), np.nan)
                y[[at[i] for i in iids]] = vals
                alike.setdefault(tuple(tuple(-1 if x is None else at[x] for x in members[k]) for k in order), []).append(y)
            for shape, ys in alike.items():
                step = max(1, TOGETHER // (len(q) * len(shape)))
                names = [(i, *(None if x < 0 else x for x in pair)) for i, pair in enumerate(shape)]
                for lo in range(0, len(ys), step):
                    y = np.array(ys[lo : lo + step])
                    known = ~np.isnan(y)
                    density = np.exp(-0.5 * ((np.where(known, y, 0.0)[:, None, :, None] - means[:, None]) / sd[:, None, None]) ** 2) / (sd[:, None, None] * np.sqrt(2 * np.pi))
                    density = np.where(known[:, None, :, None], density, 1.0).reshape(-1, len(shape), 3)
                    total += type_likelihoods(names, density, np.tile(q, len(y)), np.tile(tau, (len(y), 1))).reshape(len(y), -1).sum(0)
            return pd.DataFrame({"k": np.arange(len(q)), "ll": total})

        out = np.zeros(len(q))
        for r in task.groupBy("task").applyInPandas(score, "k int, ll double").groupBy("k").agg(F.sum("ll").alias("ll")).collect():  # a row per candidate
            out[r["k"]] = r["ll"]
        ends = np.cumsum([len(x) for x in sets.values()])
        return {m: out[e - len(x) : e] for (m, x), e in zip(sets.items(), ends)}

    rng = np.random.default_rng(seed)
    best: dict[str, tuple[float, np.ndarray]] = {}
    for turn in range(ROUNDS):
        sets = {}
        for m in models:
            a, z = np.array([low[k] for k in MODELS[m]]), np.array([high[k] for k in MODELS[m]])
            if m not in best:
                x = a + (z - a) * rng.random((CANDIDATES, len(a)))
            else:
                step = (z - a) * 0.35 * 0.62**turn
                x = np.clip(best[m][1] + step * rng.standard_normal((CANDIDATES, len(a))), a, z)
                x[0] = best[m][1]
            sets[m] = x
        if "general" in sets and "mendelian" in best:  # each model starts from those it contains
            p = dict(zip(MODELS["mendelian"], best["mendelian"][1]))
            sets["general"][1] = [p.get(k, {"t0": 0.0, "t1": 0.5, "t2": 1.0}.get(k, 0.0)) for k in MODELS["general"]]
        for m, ll in evaluate(sets).items():
            k = int(np.nanargmax(np.where(np.isfinite(ll), ll, -np.inf)))
            if m not in best or ll[k] > best[m][0]:
                best[m] = (float(ll[k]), sets[m][k])
    out = [(m, ll, float(2 * len(x) - 2 * ll), len(x), {k: float(v) for k, v in zip(MODELS[m], x)}) for m, (ll, x) in best.items()]
    return spark.createDataFrame(out, schema)
