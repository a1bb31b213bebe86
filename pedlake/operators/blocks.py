"""Blocks of genotypes: all pairs of a gene's variants, moments of a gene, pairs of samples.

What meets in pairs is never joined row by row. A task gets many genes with all their calls; matrix products over buckets of about
``BUCKET`` samples give the counts or sums of a gene's pairs at once, or, where samples have few calls in the gene, the pairs of each
sample's calls. A gene of more than ``WHOLE`` calls is cut into buckets of samples that add up by a partial aggregate. What is
shuffled is calls once and, for those genes, a row for each pair of variants called together in a bucket.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pedlake.operators.assoc import CASE, CONTROL
from pedlake.operators.cohort import Cohort
from pedlake.plans.scratch import Scratch

BUCKET = 4096
CELLS = [(i, j) for i in range(3) for j in range(3)]


def _dense(pdf: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Variants, places of the first row of each sample, and the samples x variants matrix; -1 is missing."""
    v, vi = np.unique(pdf["vidx"].to_numpy(), return_inverse=True)
    si, s = pd.factorize(pdf["iid"])
    g = np.full((len(s), len(v)), -1, dtype=np.int8)
    g[si, vi] = pdf["g"].to_numpy()
    first = np.full(len(s), -1)
    first[si[::-1]] = np.arange(len(pdf))[::-1]
    return v, first, g


def buckets(df: DataFrame, samples: int) -> DataFrame:
    """Adds ``bucket``: samples by hash, about BUCKET in each."""
    return df.withColumn("bucket", F.pmod(F.xxhash64("iid"), F.lit(max(1, -(-samples // BUCKET)))).cast("int"))


def pair_tables(c: Cohort, trait: str | None, sets: DataFrame | bool | None = None, queries: DataFrame | None = None) -> DataFrame:
    """(gene, vidx1, vidx2, a00..a22[, u00..u22]): genotype tables of all pairs of variants of a group, over samples called
    at both; of cases and of controls if a trait is given.

    sets: (gene, vidx), the gene sets unless given; False if calls have a gene themselves. queries: (vidx) restricts vidx1 to these variants, and pairs are
    then (query, any other variant of the group).
    """
    g = c.called() if sets is False else c.called().join(c.sets if sets is None else sets, "vidx")
    if trait is not None:
        g = g.join(c.trait(trait).where(F.col("val").isin(CASE, CONTROL)).select("iid", (F.col("val") == CASE).alias("case")), "iid")
    else:
        g = g.withColumn("case", F.lit(True))
    if queries is not None:
        g = g.join(queries.select("vidx").distinct().withColumn("q", F.lit(True)), "vidx", "left")
    g = g.withColumn("q", F.coalesce(F.col("q"), F.lit(False)) if queries is not None else F.lit(True))
    sides = "au" if trait is not None else "a"
    names = [f"{s}{i}{j}" for s in sides for i, j in CELLS]
    directed, width = queries is not None, len(names)
    schema = "gene string, vidx1 long, vidx2 long, " + ", ".join(f"{n} long" for n in names)
    scratch = Scratch(c.calls.sparkSession, "pairs")
    g = scratch.cut(g.select("gene", "vidx", "iid", "g", "case", "q"))
    tasks = max(4 * int(c.calls.sparkSession.conf.get("spark.sql.shuffle.partitions")), scratch.rows // (WHOLE // 2))
    large = scratch.cut(g.groupBy("gene").agg(F.count(F.lit(1)).alias("n_call")).where(F.col("n_call") > WHOLE))
    any_large = scratch.rows > 0

    def count(pdf: pd.DataFrame) -> pd.DataFrame:
        code, genes = pd.factorize(pdf["gene"])
        iid = pd.factorize(pdf["iid"])[0]
        order = np.lexsort((iid, code))
        iid, vidx, x, case, q = iid[order], *(pdf[k].to_numpy()[order] for k in ("vidx", "g", "case", "q"))
        ends = np.cumsum(np.bincount(code, minlength=len(genes)))
        out = []
        for k, (lo, hi) in enumerate(zip([0, *ends[:-1]], ends)):
            v, vi = np.unique(vidx[lo:hi], return_inverse=True)
            asked = np.isin(v, vidx[lo:hi][q[lo:hi]]) if directed else np.ones(len(v), bool)
            one, two, cells = _pair_cells(iid[lo:hi], vi, x[lo:hi].astype(np.int64), case[lo:hi], asked, directed, width)
            out.append((np.full(len(one), k), v[one], v[two], cells))
        at, one, two, cells = (np.concatenate(z) for z in zip(*out))
        return pd.DataFrame({"gene": np.asarray(genes, object)[at], "vidx1": one, "vidx2": two, **{n: cells[:, k] for k, n in enumerate(names)}})

    small = g.join(large.select("gene"), "gene", "left_anti") if any_large else g
    out = small.withColumn("task", F.pmod(F.xxhash64("gene"), F.lit(tasks))).groupBy("task").applyInPandas(count, schema)
    if not any_large:
        return out
    split = g.join(large, "gene").withColumn("bucket", F.pmod(F.xxhash64("iid"), F.ceil(F.col("n_call") / F.lit(WHOLE))).cast("int")).drop("n_call")
    part = split.groupBy("gene", "bucket").applyInPandas(count, schema)
    return out.unionByName(part.groupBy("gene", "vidx1", "vidx2").agg(*(F.sum(n).alias(n) for n in names)))


def _pair_cells(iid: np.ndarray, vi: np.ndarray, g: np.ndarray, case: np.ndarray, asked: np.ndarray, directed: bool, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places of two variants and their cells, for pairs that any sample is called at. Calls are sorted by iid; a pair is (asked, any
    other) if directed, else (earlier, later); cells of cases come first, those of controls where width is 18."""
    n_v = len(asked)
    new = np.concatenate([[True], iid[1:] != iid[:-1]])
    si = np.cumsum(new) - 1
    n_s, per = int(si[-1]) + 1, np.bincount(si)
    from_ = np.nonzero(asked[vi])[0]
    count, start = per[si[from_]], (np.cumsum(per) - per)[si[from_]]
    if 50.0 * count.sum() < float(n_s) * asked.sum() * n_v or asked.sum() * n_v > 4_000_000:  # few calls a sample: its pairs one by one
        keys, counts, bound, lo = [], [], np.cumsum(count), 0
        while lo < len(from_):
            hi = max(lo + 1, int(np.searchsorted(bound, (bound[lo - 1] if lo else 0) + (1 << 21), "right")))
            n = count[lo:hi]
            b = np.repeat(start[lo:hi] - (np.cumsum(n) - n), n) + np.arange(n.sum())
            a = np.repeat(from_[lo:hi], n)
            use = vi[a] != vi[b] if directed else vi[a] < vi[b]
            a, b = a[use], b[use]
            k, m = np.unique((vi[a] * n_v + vi[b]) * width + np.where(case[a], 0, 9) + 3 * g[a] + g[b], return_counts=True)
            keys.append(k)
            counts.append(m)
            lo = hi
        key = np.concatenate(keys) if keys else np.zeros(0, np.int64)
        pair, at = np.unique(key // width, return_inverse=True)
        cells = np.zeros((len(pair), width), np.int64)
        np.add.at(cells, (at, key % width), np.concatenate(counts) if counts else np.zeros(0, np.int64))
        return pair // n_v, pair % n_v, cells
    rows = np.nonzero(asked)[0]
    total = np.zeros((width, len(rows), n_v))
    who = case[new]
    for first in range(0, n_s, BUCKET):
        lo, hi = np.searchsorted(si, [first, first + BUCKET])
        x = np.full((min(BUCKET, n_s - first), n_v), -1, dtype=np.int8)
        x[si[lo:hi] - first, vi[lo:hi]] = g[lo:hi]
        for s in range(width // 9):
            part = x[who[first : first + BUCKET] == (s == 0)]
            hit = [(part == k).astype(np.float32) for k in range(3)]
            for k, (i, j) in enumerate(CELLS):
                total[9 * s + k] += hit[i][:, rows].T @ hit[j]
    keep = (total.sum(0) > 0) & (rows[:, None] != np.arange(n_v) if directed else rows[:, None] < np.arange(n_v))
    one, two = np.nonzero(keep)
    return rows[one], two, total[:, one, two].T.astype(np.int64)


#: Calls of a gene that one task takes whole; genes with more are added up from buckets of samples of about as many calls.
WHOLE = 1 << 18


def _cells(si: np.ndarray, vi: np.ndarray, g: np.ndarray, n_s: int, n_v: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """g'g, g'c and c'c of samples x variants with g = 0 where there is no call and c the indicator of one."""
    here = g >= 0
    si, vi, g = si[here], vi[here], g[here].astype(float)
    if n_v == 1:
        return tuple(np.array([[x]]) for x in (g @ g, g.sum(), float(len(g))))
    per = np.bincount(si, minlength=n_s)
    if 20.0 * (per.astype(float) ** 2).sum() < float(n_s) * n_v * n_v:  # few calls a sample: its pairs one by one
        order = np.argsort(si, kind="stable")
        vi, g, si = vi[order], g[order], si[order]
        start, count = (np.cumsum(per) - per)[si], per[si]
        out = np.zeros((3, n_v * n_v))
        bound, lo = np.cumsum(count), 0
        while lo < len(g):
            hi = max(lo + 1, int(np.searchsorted(bound, (bound[lo - 1] if lo else 0) + (1 << 21), "right")))
            n = count[lo:hi]
            at = np.repeat(start[lo:hi] - (np.cumsum(n) - n), n) + np.arange(n.sum())
            x, flat = np.repeat(g[lo:hi], n), np.repeat(vi[lo:hi], n) * n_v + vi[at]
            for k, w in enumerate((x * g[at], x, 1.0)):
                np.add.at(out[k], flat, w)
            lo = hi
        return tuple(x.reshape(n_v, n_v) for x in out)
    gg, gc, cc = (np.zeros((n_v, n_v)) for _ in range(3))
    order = np.argsort(si, kind="stable") if n_s > BUCKET else slice(None)
    vi, g, si = vi[order], g[order], si[order]
    for first in range(0, n_s, BUCKET):
        lo, hi = np.searchsorted(si, [first, first + BUCKET]) if n_s > BUCKET else (0, len(si))
        rows = min(BUCKET, n_s - first)
        x, c = np.zeros((rows, n_v)), np.zeros((rows, n_v))
        x[si[lo:hi] - first, vi[lo:hi]] = g[lo:hi]
        c[si[lo:hi] - first, vi[lo:hi]] = 1.0
        gg += x.T @ x
        gc += x.T @ c
        cc += c.T @ c
    return gg, gc, cc


def _sums(pdf: pd.DataFrame, ys: list[str]) -> Iterator[tuple]:
    """For each gene of a task: its name, variants, places of their first rows, number of samples, g'g, g'c, c'c, g'y, c'y, sums of y, y'y."""
    code, genes = pd.factorize(pdf["gene"])
    iid = pd.factorize(pdf["iid"])[0]
    order = np.lexsort((iid, code))
    vidx, g = pdf["vidx"].to_numpy()[order], pdf["g"].fillna(-1).to_numpy()[order]
    iid, y = iid[order], pdf[ys].to_numpy(float)[order]
    ends = np.cumsum(np.bincount(code, minlength=len(genes)))
    for gene, lo, hi in zip(genes, [0, *ends[:-1]], ends):
        who = iid[lo:hi]
        new = np.concatenate([[True], who[1:] != who[:-1]])
        si, yy = np.cumsum(new) - 1, y[lo:hi][new]
        v, first, vi = np.unique(vidx[lo:hi], return_index=True, return_inverse=True)
        x = g[lo:hi]
        yes = x >= 0
        n_s, n_v, per = len(yy), len(v), yy[si]
        gy = np.stack([np.bincount(vi[yes], (x * per[:, k])[yes], n_v) for k in range(len(ys))], 1)
        cy = np.stack([np.bincount(vi[yes], per[yes, k], n_v) for k in range(len(ys))], 1)
        yield gene, v, order[lo:hi][first], n_s, *_cells(si, vi, x, n_s, n_v), gy, cy, yy.sum(0), yy.T @ yy


def moments(calls: DataFrame, sets: DataFrame | None, y: DataFrame, fit: Callable[..., pd.DataFrame | list[tuple]], schema: str, extra: list[str] | None = None) -> DataFrame:
    """fit(gene, variants, n, X'X, X'Y, Y'Y, means[, rows of extra columns]) for each gene, over samples with traits and any
    call in the gene; it returns a frame, or rows in the order of the schema.

    calls: (vidx, iid, g) and per-variant columns ``extra``; with ``gene`` too if sets is None. y: (iid, one or more
    columns of numbers). X has missing genotypes at the variant's mean and is centred, Y is centred. X'Y is a vector
    and Y'Y a number for one column. All of it follows from sums over samples: with g = 0 where missing and c
    the indicator of a call, a centred column is g - mean c. A task takes many genes with all their calls; genes of more than WHOLE
    calls are added up from buckets of samples.
    """
    scratch = Scratch(calls.sparkSession, "moments")
    traits = [x for x in y.columns if x != "iid"]
    val = scratch.cut(y.select("iid", *(F.col(x).cast("double").alias(f"y{k}") for k, x in enumerate(traits))))
    ys = [f"y{k}" for k in range(len(traits))]
    extra = extra or []
    t = calls.join(val, "iid")
    t = t if sets is None else t.join(sets, "vidx")
    t = scratch.cut(t.select("gene", "vidx", "iid", "g", *ys, *extra))
    tasks = max(4 * int(calls.sparkSession.conf.get("spark.sql.shuffle.partitions")), scratch.rows // (WHOLE // 2))
    large = scratch.cut(t.groupBy("gene").agg(F.count(F.lit(1)).alias("n_call")).where(F.col("n_call") > WHOLE))
    any_large = scratch.rows > 0
    columns = [x.split()[0] for x in schema.split(", ")]

    def solved(gene, v, n, gg, gc, cc, gy, cy, sy, yy, rows):
        mean = np.diag(gc) / np.maximum(1, np.diag(cc))
        xx = gg - gc * mean[None, :] - gc.T * mean[:, None] + cc * np.outer(mean, mean)
        xy = gy - mean[:, None] * cy  # centred columns sum to 0
        yy = yy - np.outer(sy, sy) / n
        xy, yy = (xy[:, 0], float(yy[0, 0])) if len(sy) == 1 else (xy, yy)
        args = (gene, v, int(n), xx, xy, yy, mean)
        return fit(*args, rows) if extra else fit(*args)

    def frame(parts: list) -> pd.DataFrame:
        lists = [r for p in parts if isinstance(p, list) for r in p]
        frames = [p for p in parts if not isinstance(p, list)]
        frames += [pd.DataFrame(lists, columns=columns)] if lists or not frames else []
        return frames[0] if len(frames) == 1 else pd.concat([f for f in frames if len(f)] or frames[:1], ignore_index=True)

    def whole(pdf: pd.DataFrame) -> pd.DataFrame:
        return frame([solved(gene, v, n, *rest, pdf[extra].iloc[first].reset_index(drop=True) if extra else None) for gene, v, first, n, *rest in _sums(pdf, ys)])

    small = t.join(large.select("gene"), "gene", "left_anti") if any_large else t
    out = small.withColumn("task", F.pmod(F.xxhash64("gene"), F.lit(tasks))).groupBy("task").applyInPandas(whole, schema)
    if not any_large:
        return out
    keys = ["gene", "v1", "v2", "k", "l"]
    values = ["gg", "gc", "cg", "cc"]

    def products(pdf: pd.DataFrame) -> pd.DataFrame:
        ((gene, v, _, n, gg, gc, cc, gy, cy, sy, yy),) = _sums(pdf, ys)
        one, two = np.nonzero(np.triu(cc > 0) | np.eye(len(v), dtype=bool))
        parts = [pd.DataFrame({"v1": v[one], "v2": v[two], "k": -1, "l": -1, "gg": gg[one, two], "gc": gc[one, two], "cg": gc.T[one, two], "cc": cc[one, two]})]
        for k in range(len(ys)):  # v2 null: sums of a variant with a trait; both null: of a trait with a trait
            parts.append(pd.DataFrame({"v1": v, "v2": None, "k": k, "l": -1, "gg": gy[:, k], "gc": cy[:, k], "cg": 0.0, "cc": 0.0}))
            parts += [pd.DataFrame({"v1": [None], "v2": [None], "k": k, "l": m, "gg": [float(n)], "gc": [sy[k]], "cg": [yy[k, m]], "cc": [0.0]}) for m in range(k, len(ys))]
        return pd.concat([o.astype({"v1": "Int64", "v2": "Int64"}) for o in parts], ignore_index=True).assign(gene=gene)[[*keys, *values]]

    split = t.join(large, "gene").withColumn("bucket", F.pmod(F.xxhash64("iid"), F.ceil(F.col("n_call") / F.lit(WHOLE))).cast("int")).drop("n_call")
    sums = split.groupBy("gene", "bucket").applyInPandas(products, "gene string, v1 long, v2 long, k int, l int, gg double, gc double, cg double, cc double").groupBy(*keys).agg(*(F.sum(x).alias(x) for x in values))
    if extra:
        sums = sums.join(t.join(large.select("gene"), "gene", "left_semi").select("gene", F.col("vidx").alias("v1"), *extra).dropDuplicates(["gene", "v1"]), ["gene", "v1"], "left")

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        total = pdf[pdf["v1"].isna()]
        single = pdf[pdf["v1"].notna() & pdf["v2"].isna()].sort_values(["k", "v1"])
        zero = single[single["k"] == 0].reset_index(drop=True)
        v, n = zero["v1"].to_numpy(np.int64), float(total["gg"].iloc[0])
        m, nk = len(v), len(ys)
        sy, yy = np.zeros(nk), np.zeros((nk, nk))
        for k, l, a, b in total[["k", "l", "gc", "cg"]].itertuples(index=False):
            yy[k, l] = yy[l, k] = b
            sy[k] = a
        pairs = pdf[pdf["v2"].notna()]
        i, j = np.searchsorted(v, pairs["v1"].to_numpy(np.int64)), np.searchsorted(v, pairs["v2"].to_numpy(np.int64))
        gg, gc, cc = np.zeros((m, m)), np.zeros((m, m)), np.zeros((m, m))
        gg[i, j] = gg[j, i] = pairs["gg"].to_numpy(float)
        gc[i, j], gc[j, i] = pairs["gc"].to_numpy(float), pairs["cg"].to_numpy(float)
        cc[i, j] = cc[j, i] = pairs["cc"].to_numpy(float)
        gy, cy = (np.column_stack([x[c].to_numpy(float) for _, x in single.groupby("k")]) for c in ("gg", "gc"))
        return frame([solved(pdf["gene"].iloc[0], v, n, gg, gc, cc, gy, cy, sy, yy, zero)])

    return out.unionByName(sums.groupBy("gene").applyInPandas(solve, schema))
