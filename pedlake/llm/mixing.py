"""Mixing sources to target weights, by entropy balancing.

Each document d of source s gets a rate r_d in [0, cap_s], the expected number of its copies. Wanted are the
rates nearest to the documents' own base rates q_d (1 unless ``log_weight`` is given) in relative entropy,

    minimise sum_d r_d log(r_d / q_d) - r_d   with   sum over s of tokens_d * r_d = share_s * total  for all s.

The convex dual has one multiplier per token constraint, and the tokens enter the tilt:

    r_d = min(cap_s, q_d * exp(lambda_s * tokens_d)).

All multipliers are solved together by Newton steps: every round is one distributed aggregate that returns, for
each source, the dual's gradient and curvature at the Newton point and at points spread over the interval that
is known to hold the solution; the best bracket and its Newton step make the next round. Rates depend on
(source, tokens, weight) only, so a round reads a row per such triple and not the documents. A solution that
isn't reached in ``rounds`` raises.

Rates are then rounded into copies: the whole part always, one more for documents in the order of a hash of
doc_id relative to their fraction, until the budget is reached. That order is cut in two steps (sums of 4096
ranges, then the documents of one range), so the largest source isn't sorted, and the shares are met to within
about one document per source.

The total is the largest that all caps allow, or ``total_tokens`` if that is less; ``shares`` tells what was asked
for, so a total or a source that falls short is seen there.

Cases: documents of sources that have no target, or of null source, are not used, nor are those
without tokens; a source without tokens is reported with share 0 and the others keep their
relations; null or negative shares and caps count as 0; repeated target rows count once; equal
hashes are ordered by doc_id.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from pedlake.llm.tokenizer import VOCABULARY, count_tokens
from pedlake.plans.scratch import Scratch

RANGES = 4096
#: The table of targets is read by the driver; it may not be larger.
MOST_TARGETS = 10_000


def _targets(mix_targets: DataFrame) -> dict[str, tuple[float, float]]:
    rows = mix_targets.select("source", "target_share", "max_repeats").where(F.col("source").isNotNull()).distinct().limit(MOST_TARGETS + 1).collect()
    if len(rows) > MOST_TARGETS:
        raise ValueError(f"more than {MOST_TARGETS} targets")
    return {r["source"]: (max(0.0, r["target_share"] or 0.0), max(0, r["max_repeats"] or 0)) for r in rows}


#: Points of one round, the Newton point among them.
POINTS = 8


def solve(sums: DataFrame, budgets: dict[str, float], caps: dict[str, float], rounds: int = 60, tolerance: float = 1e-9) -> dict[str, float]:
    """The multiplier lambda of each source. sums: (source, b, tokens, n), n documents of one size and log weight b.

    A budget that needs every copy has an infinite multiplier, one of nothing a negative infinite.
    """
    spark = sums.sparkSession
    cap_of = F.broadcast(spark.createDataFrame([(s, max(caps[s], 1e-300)) for s in sorted(caps)], "source string, cap double"))
    t, n, b = F.col("tokens").cast("double"), F.col("n").cast("double"), F.col("b")
    first = sums.join(cap_of, "source").groupBy("source").agg(F.sum(n * t).alias("whole"), F.sum(n * t * F.exp(b)).alias("free"), F.min(t).alias("least"), F.max((F.log("cap") - b) / t).alias("top"))
    m, low, high, points = {}, {}, {}, {}
    for r in first.collect():  # a row per source
        s = r["source"]
        if budgets[s] >= caps[s] * r["whole"] * (1 - tolerance):
            m[s] = math.inf
        elif budgets[s] <= 0:
            m[s] = -math.inf
        else:  # at low the budget isn't reached even without caps, at high every document is at its cap
            low[s], high[s] = min(0.0, math.log(budgets[s] / r["free"]) / r["least"]) - 1e-12, max(r["top"], 0.0) + 1e-12
            points[s] = [low[s] + (high[s] - low[s]) * (k + 1) / (POINTS + 1) for k in range(POINTS)]
    for _ in range(rounds):
        if not points:
            return m
        now = F.broadcast(spark.createDataFrame([(s, max(caps[s], 1e-300), x) for s, x in sorted(points.items())], "source string, cap double, x array<double>"))
        sides = []
        for k in range(POINTS):
            free = F.exp(b + F.get("x", F.lit(k)) * t)
            sides += [F.sum(n * t * F.least("cap", free)).alias(f"v{k}"), F.sum(n * t * t * F.when(free < F.col("cap"), free).otherwise(0.0)).alias(f"s{k}")]
        for r in sums.join(now, "source").groupBy("source").agg(*sides).collect():  # a row per source
            s = r["source"]
            found = sorted((x, r[f"v{k}"] - budgets[s], r[f"s{k}"]) for k, x in enumerate(points[s]))
            x, gap, slope = min(found, key=lambda f: abs(f[1]))
            if abs(gap) <= tolerance * budgets[s] or high[s] - low[s] <= 1e-15 * max(1.0, abs(x)):
                m[s] = x
                del points[s]
                continue
            low[s], high[s] = max([low[s], *(f[0] for f in found if f[1] < 0)]), min([high[s], *(f[0] for f in found if f[1] > 0)])
            step = x - gap / slope if slope > 0 else math.nan
            near = step if low[s] < step < high[s] else (low[s] + high[s]) / 2
            spread = [low[s] + (high[s] - low[s]) * (k + 1) / POINTS for k in range(POINTS - 1)]
            points[s] = [near, *spread]
    if points:
        raise ArithmeticError(f"no solution in {rounds} rounds for {sorted(points)[:5]}")
    return m


def mixture(documents: DataFrame, mix_targets: DataFrame, vocabulary: str = VOCABULARY, total_tokens: float | None = None, log_weight: Column | None = None) -> DataFrame:
    """(doc_id, source, n_tokens, rate, copies) for every document that is used at least once."""
    spark = documents.sparkSession
    scratch = Scratch(spark, "mixing")
    goal = _targets(mix_targets)
    weighted = documents.select("doc_id", "source", "text", (F.lit(0.0) if log_weight is None else F.coalesce(log_weight.cast("double"), F.lit(0.0))).alias("b"))
    wanted = [s for s, (share, cap) in goal.items() if share > 0 and cap > 0]
    docs = scratch.cut(count_tokens(weighted.where(F.col("source").isin(wanted)), vocabulary, ("doc_id", "source", "b")).where("n_tokens > 0"))
    sums = scratch.cut(docs.groupBy("source", "b", F.col("n_tokens").alias("tokens")).agg(F.count(F.lit(1)).alias("n")))
    have = {r["source"]: r["tokens"] for r in sums.groupBy("source").agg(F.sum(F.col("tokens") * F.col("n")).alias("tokens")).collect()}
    schema = "doc_id bigint, source string, n_tokens bigint, rate double, copies int"
    if not have:
        return spark.createDataFrame([], schema)
    whole = sum(goal[s][0] for s in have)
    total = min(goal[s][1] * have[s] / (goal[s][0] / whole) for s in have)
    total = total if total_tokens is None else min(total, total_tokens)
    budgets = {s: total * goal[s][0] / whole for s in have}
    caps = {s: float(goal[s][1]) for s in have}
    m = solve(sums, budgets, caps)

    per_source = F.broadcast(spark.createDataFrame([(s, caps[s], m[s], budgets[s]) for s in sorted(have)], "source string, cap double, m double, budget double"))
    rated = docs.join(per_source, "source").withColumn("rate", F.least("cap", F.exp(F.col("b") + F.col("m") * F.col("n_tokens"))))
    # a hash in (0, 1), relative to the fraction: the documents below 1 are those of independent rounding
    u = (F.pmod(F.xxhash64("doc_id"), F.lit(1 << 52)) + 0.5) / float(1 << 52)
    rated = rated.withColumn("base", F.floor(F.col("rate") + 1e-9)).withColumn("part", F.greatest(F.col("rate") - F.col("base"), F.lit(0.0)))
    rated = rated.withColumn("score", F.when(F.col("part") > 1e-9, u / F.col("part"))).withColumn("slot", F.least(F.floor(F.col("score") * (RANGES // 4)), F.lit(RANGES - 1)).cast("int"))
    rated = scratch.cut(rated.select("doc_id", "source", "n_tokens", "rate", "base", "score", "slot"))
    fixed, slots = dict.fromkeys(have, 0.0), {}
    for r in rated.groupBy("source", "slot").agg(F.sum(F.col("n_tokens") * F.col("base")).alias("sure"), F.sum("n_tokens").alias("n")).collect():  # at most RANGES + 1 rows per source
        fixed[r["source"]] += r["sure"]
        if r["slot"] is not None:
            slots.setdefault(r["source"], {})[r["slot"]] = r["n"]
    edges = []
    for s in sorted(have):
        need, at = budgets[s] - fixed[s], -1
        for k in sorted(slots.get(s, {})):
            at = k
            if need < slots[s][k]:
                break
            need -= slots[s][k]
            at = k + 1
        edges.append((s, at, float(max(0.0, need))))
    edge = F.broadcast(spark.createDataFrame(edges, "source string, edge int, need double"))
    cut = rated.join(edge, "source")
    order = Window.partitionBy("source").orderBy("score", "doc_id").rowsBetween(Window.unboundedPreceding, 0)
    last = cut.where(F.col("slot") == F.col("edge")).withColumn("more", (F.sum("n_tokens").over(order) - F.col("n_tokens") / 2 <= F.col("need")).cast("int"))
    rest = cut.where(F.col("slot").isNull() | (F.col("slot") != F.col("edge"))).withColumn("more", F.coalesce((F.col("slot") < F.col("edge")).cast("int"), F.lit(0)))
    out = last.unionByName(rest).select("doc_id", "source", F.col("n_tokens").cast("long").alias("n_tokens"), "rate", (F.col("base") + F.col("more")).cast("int").alias("copies"))
    return out.where("copies > 0")


def shares(documents: DataFrame, mix_targets: DataFrame, vocabulary: str = VOCABULARY, total_tokens: float | None = None) -> DataFrame:
    """The share each source really reaches, with its documents, copies and greatest repeat; and how many tokens it lacks
    of its target share of the total (``total_tokens`` if given), beyond what its copies can give."""
    got = mixture(documents, mix_targets, vocabulary, total_tokens).groupBy("source").agg(F.count(F.lit(1)).alias("n_documents"), F.sum("copies").alias("n_copies"), F.max("copies").alias("most_repeats"), F.sum(F.col("copies") * F.col("n_tokens")).alias("tokens"))
    out = mix_targets.select("source", "target_share", "max_repeats").distinct().join(got, "source", "left").fillna(0, ["n_documents", "n_copies", "most_repeats", "tokens"])
    one = Window.partitionBy()  # a row per source
    goal = F.greatest(F.coalesce("target_share", F.lit(0.0)), F.lit(0.0))
    total = F.sum("tokens").over(one) if total_tokens is None else F.lit(float(total_tokens))
    out = out.withColumn("share", F.col("tokens") / F.nullif(F.sum("tokens").over(one), F.lit(0)))
    return out.withColumn("lacks", F.greatest(F.lit(0.0), goal / F.nullif(F.sum(goal).over(one), F.lit(0.0)) * total - F.col("tokens")))
