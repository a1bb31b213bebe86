"""Parent-child links to full hierarchies, by leaf peeling.

Bottom-up, a person whose children are all done is peeled and hands its descendants and their number
to its parents; the round of peeling is its height. In reverse order the father's line gets paths and
depths. What can't be peeled reaches a cycle downwards; in that residue strongly connected components
tell the persons on a cycle from their mere ancestors.

Scale: lineages are independent. Families of up to ``local_rows`` rows are peeled whole inside a task,
many to a task. A larger family is first parted into connected lineages; those still larger are
peeled by rounds of DataFrame joins over (child, parent) edges, which hold no list of a whole
family anywhere. Both ways give the same rows.

Cases: rows without famid or pid are no persons; null and 0 are no parents; a named parent without a
row is a node with ``has_row`` false and may be the root of a path; of several fathers named by
unequal rows of a person the path takes the least, descendants take all; a father's line that runs
into a cycle has no root, so path, depth and root are null; exact duplicates count once.
"""

from __future__ import annotations

from collections import defaultdict
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pedlake.functions.keys import parent_id, same_id
from pedlake.operators.components import components
from pedlake.plans.scratch import Scratch

#: A lineage of more rows isn't peeled within one task.
LOCAL_ROWS = 5000
NODE = "famid string, pid string, has_row boolean, path array<string>, depth int, root string, height int, n_descendants long, in_cycle boolean"


def _on_cycles(nodes: list[int], up: list[set[int]]) -> set[int]:
    """Nodes of strongly connected components with an inner edge, by Tarjan's walk without recursion."""
    index, low, onstack, stack, found, n = {}, {}, set(), [], set(), 0
    inside = set(nodes)
    for s in nodes:
        if s in index:
            continue
        work = [(s, iter(up[s]))]
        index[s] = low[s] = n
        n += 1
        stack.append(s)
        onstack.add(s)
        while work:
            v, it = work[-1]
            for w in it:
                if w not in inside:
                    continue
                if w not in index:
                    index[w] = low[w] = n
                    n += 1
                    stack.append(w)
                    onstack.add(w)
                    work.append((w, iter(up[w])))
                    break
                if w in onstack:
                    low[v] = min(low[v], index[w])
            else:
                work.pop()
                if work:
                    low[work[-1][0]] = min(low[work[-1][0]], low[v])
                if low[v] == index[v]:
                    part = []
                    while True:
                        w = stack.pop()
                        onstack.discard(w)
                        part.append(w)
                        if w == v:
                            break
                    if len(part) > 1 or v in up[v]:
                        found.update(part)
    return found


def _peel(pdf: pd.DataFrame, descendants: bool) -> pd.DataFrame:
    """All lineages of one task."""
    ids: dict[tuple[str, str], int] = {}
    node = lambda f, p: ids.setdefault((f, p), len(ids))
    rows, edges, father = set(), set(), {}
    for f, p, a, m in zip(pdf["famid"], pdf["pid"], pdf["fatid"], pdf["motid"]):
        c = node(f, p)
        rows.add(c)
        for x in (a, m):
            if isinstance(x, str):
                edges.add((c, node(f, x)))
        if isinstance(a, str):
            father[c] = min(father[c], (a, ids[f, a])) if c in father else (a, ids[f, a])
    names = list(ids)
    up = [set() for _ in names]
    down = [set() for _ in names]
    for c, p in edges:
        up[c].add(p)
        down[p].add(c)
    left, height, below = [len(d) for d in down], [-1] * len(names), [None] * len(names)
    leaves, turn = [i for i, k in enumerate(left) if not k], 0
    order = []
    while leaves:
        after = []
        for i in leaves:
            height[i] = turn
            order.append(i)
            if descendants:
                below[i] = set().union(down[i], *(below[c] for c in down[i]))
            for p in up[i]:
                left[p] -= 1
                if not left[p]:
                    after.append(p)
        leaves, turn = after, turn + 1
    rest = [i for i, h in enumerate(height) if h < 0]
    cyclic = _on_cycles(rest, up)
    if descendants:
        for i in rest:
            seen, todo = set(), list(down[i])
            while todo:
                x = todo.pop()
                if x not in seen:
                    seen.add(x)
                    if below[x] is not None and height[x] >= 0:
                        seen |= below[x]
                    else:
                        todo += down[x]
            below[i] = seen
    lines: dict[int, list[str] | None] = {}
    for i in [*rest, *reversed(order)]:
        todo, x, on = [], i, set()
        while x not in lines and x not in on:
            todo.append(x)
            on.add(x)
            if x not in father:
                break
            x = father[x][1]
        for y in reversed(todo):
            if y not in father:
                lines[y] = [names[y][1]]
            else:
                over = lines.get(father[y][1])
                lines[y] = None if over is None else [names[y][1], *over]
    out = []
    for i, (f, p) in enumerate(names):
        line = lines[i]
        row = (f, p, i in rows, line, None if line is None else len(line) - 1, None if line is None else line[-1], height[i] if height[i] >= 0 else None, len(below[i]) if descendants else None, i in cyclic)
        out.append((*row, sorted(names[x][1] for x in below[i])) if descendants else row)
    cols = ["famid", "pid", "has_row", "path", "depth", "root", "height", "n_descendants", "in_cycle", *["descendants"] * descendants]
    return pd.DataFrame(out, columns=cols).astype({"depth": "Int32", "height": "Int32", "n_descendants": "Int64"})


def _links(person: DataFrame) -> DataFrame:
    rows = person.select(same_id("famid").alias("famid"), same_id("pid").alias("pid"), parent_id("fatid").alias("fatid"), parent_id("motid").alias("motid"))
    return rows.where(F.col("famid").isNotNull() & F.col("pid").isNotNull()).distinct()


class Hierarchy:
    """Nodes and descendant pairs of all lineages of ``person``."""

    def __init__(self, person: DataFrame, descendants: bool = True, local_rows: int = LOCAL_ROWS):
        self.spark, self.descendants = person.sparkSession, descendants
        self.scratch = s = Scratch(self.spark, "hierarchy")
        rows = s.cut(_links(person))
        total = s.rows
        sizes = rows.groupBy("famid").agg(F.count(F.lit(1)).alias("n"))
        large = s.cut(sizes.where(F.col("n") > local_rows).select("famid"))
        keyed, rounds = rows.withColumn("lineage", F.col("famid")), None
        if s.rows:
            wide = s.cut(rows.join(large, "famid", "left_semi"))
            name = lambda c: F.concat("famid", F.lit("\0"), c)
            links = wide.select(name("pid").alias("a"), F.explode(F.filter(F.array("fatid", "motid"), lambda x: x.isNotNull())).alias("p"), "famid").select("a", F.concat("famid", F.lit("\0"), "p").alias("b"))
            parts = components(links)
            wide = s.cut(wide.withColumn("vertex", name("pid")).join(parts, "vertex", "left").withColumn("lineage", F.coalesce("component", "vertex")).drop("vertex", "component"))
            big = s.cut(wide.groupBy("lineage").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > local_rows).select("lineage"))
            if s.rows:
                rounds = s.cut(wide.join(big, "lineage", "left_semi").drop("lineage"))
            keyed = rows.join(large, "famid", "left_anti").withColumn("lineage", F.col("famid")).unionByName(wide.join(big, "lineage", "left_anti"))
        tasks = max(1, -(-total // local_rows))
        schema = NODE + (", descendants array<string>" if descendants else "")
        self.local = s.cut(keyed.groupBy(F.pmod(F.xxhash64("lineage"), F.lit(tasks)).alias("task")).applyInPandas(lambda pdf: _peel(pdf, descendants), schema))
        self.wide = None if rounds is None else _Rounds(s, rounds, descendants)

    def nodes(self) -> DataFrame:
        """One row per person or named parent: columns of NODE."""
        cols = [c.split()[0] for c in NODE.split(", ")]
        local = self.local.select(*cols)
        return local if self.wide is None else local.unionByName(self.wide.nodes().select(*cols))

    def pairs(self) -> DataFrame:
        """(famid, pid, descendant) for all descendants through either parent, distinct."""
        local = self.local.select("famid", "pid", F.explode("descendants").alias("descendant"))
        return local if self.wide is None else local.unionByName(self.wide.pairs())


class _Rounds:
    """Peeling of lineages too large for a task: one join per round, over written tables."""

    def __init__(self, scratch: Scratch, rows: DataFrame, descendants: bool):
        self.s, self.rows, self.descendants = scratch, rows, descendants
        s = scratch
        self.edges = s.cut(rows.select("famid", F.col("pid").alias("c"), F.explode(F.filter(F.array("fatid", "motid"), lambda x: x.isNotNull())).alias("p")).distinct())
        self.heights, self.below = [], []
        rest = self.edges
        turn, before = 0, s.rows
        busy = self._ends(rest, "p")
        alone = self._all().join(busy, ["famid", "pid"], "left_anti")
        self.heights.append(s.cut(alone.withColumn("height", F.lit(0))))
        while before:
            kept = s.cut(rest.join(self._ends(rest, "p").withColumnRenamed("pid", "c"), ["famid", "c"], "left_semi"))
            if s.rows == before:
                break
            before, turn = s.rows, turn + 1
            gone = self._minus(rest, kept)
            if descendants:
                own = gone.select("famid", F.col("p").alias("pid"), F.col("c").alias("descendant"))
                if self.below:
                    known = reduce(DataFrame.unionByName, self.below)
                    own = own.unionByName(gone.join(known.withColumnRenamed("pid", "c"), ["famid", "c"]).select("famid", F.col("p").alias("pid"), "descendant"))
                self.below.append(s.cut(own.distinct()))
            done = self._ends(gone, "p").join(self._ends(kept, "p"), ["famid", "pid"], "left_anti")
            self.heights.append(s.cut(done.withColumn("height", F.lit(turn))))
            rest = kept
        self.residue = rest
        self.cyclic = self._cycles(rest)
        if descendants:
            self._close(rest)

    def _all(self) -> DataFrame:
        return self.rows.select("famid", "pid").unionByName(self._ends(self.edges, "p")).distinct()

    @staticmethod
    def _ends(edges: DataFrame, end: str) -> DataFrame:
        return edges.select("famid", F.col(end).alias("pid")).distinct()

    @staticmethod
    def _minus(edges: DataFrame, other: DataFrame) -> DataFrame:
        return edges.join(other, ["famid", "c", "p"], "left_anti")

    def _trim(self, edges: DataFrame) -> DataFrame:
        """Edges between nodes that have both a parent and a child in what is left."""
        s, before = self.s, -1
        edges = s.cut(edges)
        while s.rows and s.rows != before:
            before = s.rows
            both = self._ends(edges, "p").intersect(self._ends(edges, "c"))
            last = edges
            edges = s.cut(edges.join(both.withColumnRenamed("pid", "p"), ["famid", "p"], "left_semi").join(both.withColumnRenamed("pid", "c"), ["famid", "c"], "left_semi"))
            s.drop(last)
        return edges

    def _cycles(self, edges: DataFrame) -> DataFrame:
        """Persons on a cycle: colouring by the greatest ancestor, then the way back within a colour."""
        s, found = self.s, [edges.select("famid", F.col("c").alias("pid")).limit(0)]
        edges = self._trim(edges)
        while s.rows:
            colour = s.cut(self._ends(edges, "c").withColumn("colour", F.col("pid")))
            while True:  # from parent to child until nothing changes
                sent = edges.join(colour.withColumnRenamed("pid", "p"), ["famid", "p"]).select("famid", F.col("c").alias("pid"), "colour")
                new = s.cut(colour.withColumn("old", F.col("colour")).unionByName(sent.withColumn("old", F.lit(None).cast("string"))).groupBy("famid", "pid").agg(F.max("colour").alias("colour"), F.max("old").alias("old")))
                changed = new.where("colour != old").limit(1).count()
                s.drop(colour)
                colour = s.cut(new.drop("old"))
                s.drop(new)
                if not changed:
                    break
            inner = s.cut(edges.join(colour.withColumnRenamed("pid", "c"), ["famid", "c"]).join(colour.select("famid", F.col("pid").alias("p"), "colour"), ["famid", "p", "colour"]))
            back = [s.cut(inner.where("p = colour or c = colour").select("famid", "colour", F.col("colour").alias("pid")).distinct())]
            while s.rows:  # from child to parent within the colour
                known = reduce(DataFrame.unionByName, back)
                step = back[-1].withColumnRenamed("pid", "c").join(inner, ["famid", "colour", "c"]).select("famid", "colour", F.col("p").alias("pid")).distinct()
                back.append(s.cut(step.join(known, ["famid", "colour", "pid"], "left_anti")))
            # a root has an inner edge only if it is reached back from itself
            parts = reduce(DataFrame.unionByName, back)
            ring = parts.join(inner.select("famid", "colour", F.col("c").alias("pid")), ["famid", "colour", "pid"], "left_semi").join(inner.join(parts.withColumnRenamed("pid", "c"), ["famid", "colour", "c"], "left_semi").select("famid", "colour", F.col("p").alias("pid")), ["famid", "colour", "pid"], "left_semi")
            found.append(s.cut(ring.select("famid", "pid")))
            roots = colour.where("pid = colour").select("famid", "pid")
            out = parts.select("famid", "pid").unionByName(roots).distinct()
            edges = self._trim(edges.join(out.withColumnRenamed("pid", "c"), ["famid", "c"], "left_anti").join(out.withColumnRenamed("pid", "p"), ["famid", "p"], "left_anti"))
        return reduce(DataFrame.unionByName, found)

    def _close(self, edges: DataFrame) -> None:
        """Descendants of the residue: new pairs go up its edges until none is new."""
        s = self.s
        start = edges.select("famid", F.col("p").alias("pid"), F.col("c").alias("descendant"))
        if self.below:
            start = start.unionByName(reduce(DataFrame.unionByName, self.below).join(self._ends(edges, "p"), ["famid", "pid"], "left_semi"))
        new = s.cut(start.distinct())
        self.below.append(new)
        while s.rows:
            known = reduce(DataFrame.unionByName, self.below)
            up = edges.join(new.withColumnRenamed("pid", "c"), ["famid", "c"]).select("famid", F.col("p").alias("pid"), "descendant").distinct()
            new = s.cut(up.join(known, ["famid", "pid", "descendant"], "left_anti"))
            self.below.append(new)

    def pairs(self) -> DataFrame:
        return reduce(DataFrame.unionByName, self.below).distinct() if self.below else self.rows.select("famid", "pid", F.col("pid").alias("descendant")).limit(0)

    def nodes(self) -> DataFrame:
        s = self.s
        father = s.cut(self.rows.where(F.col("fatid").isNotNull()).groupBy("famid", "pid").agg(F.min("fatid").alias("fatid")))
        top = self._all().join(father, ["famid", "pid"], "left_anti")
        layers = [s.cut(top.withColumn("path", F.array("pid")))]
        while s.rows:
            down = layers[-1].withColumnRenamed("pid", "fatid").join(father, ["famid", "fatid"])
            layers.append(s.cut(down.select("famid", "pid", F.concat(F.array("pid"), "path").alias("path"))))
        lines = reduce(DataFrame.unionByName, layers)
        heights = reduce(DataFrame.unionByName, self.heights)
        key = ["famid", "pid"]
        out = self._all().join(lines, key, "left").join(heights, key, "left")
        out = out.join(self.rows.select(*key).distinct().withColumn("row", F.lit(True)), key, "left").join(self.cyclic.distinct().withColumn("ring", F.lit(True)), key, "left")
        out = out.withColumn("depth", F.when(F.col("path").isNotNull(), F.size("path") - 1)).withColumn("root", F.element_at("path", -1)).withColumn("has_row", F.coalesce("row", F.lit(False))).withColumn("in_cycle", F.coalesce("ring", F.lit(False)))
        if not self.descendants:
            return out.withColumn("n_descendants", F.lit(None).cast("long"))
        n = self.pairs().groupBy(*key).agg(F.count(F.lit(1)).alias("n"))
        return out.join(n, key, "left").withColumn("n_descendants", F.coalesce("n", F.lit(0).cast("long")))


def hierarchy(person: DataFrame, descendants: bool = True, local_rows: int = LOCAL_ROWS) -> Hierarchy:
    return Hierarchy(person, descendants, local_rows)
