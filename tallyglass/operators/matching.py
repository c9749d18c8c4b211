"""Covariate matching and balance."""

from __future__ import annotations

import heapq
import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyglass.functions.intervals import ratio
from tallyglass.operators.ranks import cut, kept, numbered, placed
from tallyglass.operators.rates import r9


def standardized(df: DataFrame, features: list[str], by: str) -> DataFrame:
    """Features as z scores within ``by`` (population deviation; constant features are 0)."""
    df = kept(df)
    stats = df.groupBy(F.col(by).alias("_of")).agg(*[c for f in features for c in (F.avg(f).alias(f"_avg_{f}"), F.stddev_pop(f).alias(f"_sd_{f}"))])
    z = [F.coalesce((F.col(f) - F.col(f"_avg_{f}")) / F.nullif(F.col(f"_sd_{f}"), F.lit(0.0)), F.lit(0.0)).alias(f"z_{f}") for f in features]
    return df.join(F.broadcast(stats), F.col(by).eqNullSafe(F.col("_of"))).select(*df.columns, *z)


STEP = 3  # bits of each coordinate that one level of cells adds


def nearest_control(df: DataFrame, features: list[str], by: str, key: str, treated: str, bits: int = 12) -> DataFrame:
    """The nearest control of each treated row in the same stratum, with replacement; ties to the smaller key.

    Distinct control vectors lie in cells within cells, each with the box around its vectors and one of them. All distinct treated vectors go down level by
    level: the vectors that the cells name bound the distance from above, and a cell whose box is further away goes. So a vector meets the few cells around its
    nearest control, wherever that lies, and the controls of the last of them, and no two sides of a stratum are multiplied.
    """
    z = standardized(df, features, by)
    at = [f"z_{f}" for f in features]
    # what the features are computed from is read once
    z = kept(z.select(by, key, treated, *[F.round(F.col(c), 9).alias(f"r_{c}") for c in at]))
    rs = [f"r_{c}" for c in at]
    levels = max(1, min(bits, 60 // len(rs)) // STEP)
    # vectors of both sides; the grid spans them all
    points = z.where(F.col(treated)).select(by, *rs).distinct()
    controls = z.where(~F.col(treated)).groupBy(by, *rs).agg(F.min(key).alias("control"))
    ends = z.agg(*[f(r).alias(f"{n}{i}") for i, r in enumerate(rs) for n, f in (("lo", F.min), ("hi", F.max))]).first()
    least = [ends[f"lo{i}"] or 0.0 for i in range(len(rs))]
    width = max([(ends[f"hi{i}"] or 0.0) - low for i, low in enumerate(least)] + [1e-9])
    fine = 1 << (levels * STEP)
    place = [F.least(F.lit(fine - 1), F.floor((F.col(r) - low) / width * fine)).cast("long") for r, low in zip(rs, least, strict=True)]

    def cell(level: int) -> Column:
        down = (levels - level) * STEP
        return sum((F.shiftleft(F.shiftright(p, down), i * levels * STEP) for i, p in enumerate(place[1:], 1)), F.shiftright(place[0], down))

    every = F.array(*[F.struct(F.lit(t).alias("level"), cell(t).alias("cell"), (cell(t - 1) if t > 1 else F.lit(0).cast("long")).alias("parent")) for t in range(1, levels + 1)])
    boxes = controls.withColumn("c", F.explode(every)).groupBy(by, "c.level", "c.cell", "c.parent").agg(
        F.min(F.struct(*rs)).alias("one"), *[f(r).alias(f"{n}{i}") for i, r in enumerate(rs) for n, f in (("lo", F.min), ("hi", F.max))]
    )
    boxes = kept(boxes)
    square = lambda gaps: sum((g * g for g in gaps[1:]), gaps[0] * gaps[0])
    front = points.withColumn("parent", F.lit(0).cast("long")).withColumn("most", F.lit(float("inf")))
    mine = Window.partitionBy(by, *rs)
    for t in range(1, levels + 1):
        met = front.join(boxes.where(F.col("level") == t).drop("level"), [by, "parent"])
        near = square([F.greatest(F.lit(0.0), F.col(f"lo{i}") - F.col(r), F.col(r) - F.col(f"hi{i}")) for i, r in enumerate(rs)])
        named = square([F.col(r) - F.col(f"one.{r}") for r in rs])
        met = met.select(by, *rs, F.col("cell").alias("parent"), near.alias("near"), F.least("most", named).alias("most"))
        # gaps are compared to nine places, so what is nearly as near stays
        front = met.withColumn("most", F.min("most").over(mine)).where(F.col("near") <= F.col("most") + 1e-8).drop("near")
    leaves = controls.select(by, "control", cell(levels).alias("parent"), *[F.col(r).alias(f"c_{r}") for r in rs])
    gap = F.round(square([F.col(r) - F.col(f"c_{r}") for r in rs]), 9)
    best = front.join(leaves, [by, "parent"]).groupBy(by, *rs).agg(F.min(F.struct(gap.alias("gap"), "control")).alias("best"))
    return z.where(F.col(treated)).join(best, [by, *rs]).select(by, key, F.col("best.control").alias("control"), F.col("best.gap").alias("gap"))


def smd(df: DataFrame, features: list[str], treated: str) -> DataFrame:
    """Standardised mean difference of each feature with pooled sample variance."""
    long = df.select(F.col(treated).alias("t"), F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("x")) for f in features])).alias("s")).select("t", "s.*")
    side = lambda fn, t: fn(F.when(F.col("t") == t, F.col("x")))
    m = long.groupBy("feature").agg(side(F.avg, True).alias("m1"), side(F.avg, False).alias("m0"), side(F.var_samp, True).alias("v1"), side(F.var_samp, False).alias("v0"))
    d = ratio(F.col("m1") - F.col("m0"), F.sqrt((F.col("v1") + F.col("v0")) / 2))
    return m.select("feature", r9(d).alias("smd"), (F.abs(d) <= 0.1).alias("balanced"))


def paired_smd(pairs: DataFrame, features: dict[str, tuple[str, str]]) -> DataFrame:
    """feature, n, smd of matched pairs: the mean difference by the differences' sample deviation. features: name -> (treated column, control column)."""
    each = F.array(*[F.struct(F.lit(f).alias("feature"), (F.col(a) - F.col(b)).cast("double").alias("gap")) for f, (a, b) in features.items()])
    by = pairs.select(F.explode(each).alias("s")).select("s.*").dropna().groupBy("feature")
    return by.agg(F.count("*").alias("n"), r9(F.try_divide(F.avg("gap"), F.stddev_samp("gap"))).alias("smd"))


def assign(cost: np.ndarray) -> list[int]:
    """Column of each row in the cheapest one-to-one assignment (rows <= columns)."""
    return assign_rows(*cost.shape, cost.__getitem__)


def assign_rows(n: int, m: int, cost: Callable[[int], np.ndarray]) -> list[int]:
    """The same by shortest augmenting paths, with each row of the cost matrix made when it is met: memory is a few rows."""
    u, v, owner = np.zeros(n + 1), np.zeros(m + 1), np.zeros(m + 1, int)
    for i in range(1, n + 1):
        owner[0], j = i, 0
        least, via, used = np.full(m + 1, np.inf), np.zeros(m + 1, int), np.zeros(m + 1, bool)
        while owner[j]:
            used[j] = True
            gap = cost(owner[j] - 1) - u[owner[j]] - v[1:]
            better = ~used[1:] & (gap < least[1:])
            least[1:][better], via[1:][better] = gap[better], j
            nxt = int(np.where(used, np.inf, least)[1:].argmin()) + 1
            delta = least[nxt]
            u[owner[used]] += delta
            v[used] -= delta
            least[~used] -= delta
            j = nxt
        while j:
            owner[j] = owner[via[j]]
            j = via[j]
    out = [0] * n
    for j in range(1, m + 1):
        if owner[j]:
            out[owner[j] - 1] = j - 1
    return out


DEPTH = 12  # suppliers that a list begins with, besides two for each row of its point
GRID = 1000  # cells lie on log(1 + GRID * distance from the least value), so they are finer there

LEAF = 24

BLOCK = 8192  # points that choose in one task
SHARE = 0.6  # lists are made at a time for seekers of so many of the free suppliers
WIDER = 16  # times the length of a list that was too short; they are few
FEW = 1000  # with no more suppliers free than this, for all that are left


def _square(gaps: list[Column]) -> Column:
    return sum((g * g for g in gaps[1:]), gaps[0] * gaps[0])


def _cells(suppliers: DataFrame, rs: list[str], ends: list[float], bits: int = 12, step: int = 2) -> tuple[int, Callable[[int], Column], DataFrame]:
    """How far down to go, the cell of a row at a level, and all levels' cells with their rows' number and the box around them.

    The last level is the first where a vector shares its cell with ``LEAF`` others on average, so it is deeper for more rows.
    """
    low, high = ends[: len(rs)], ends[len(rs) :]
    levels = max(1, min(bits, 60 // len(rs)) // step)
    fine = 1 << (levels * step)
    place = [F.least(F.lit(fine - 1), F.floor(F.log1p((F.col(r) - a) * GRID) * (fine / max(math.log1p((b - a) * GRID), 1e-9)))).cast("long") for r, a, b in zip(rs, low, high, strict=True)]

    def cell(level: int) -> Column:
        down = (levels - level) * step
        return sum((F.shiftleft(F.shiftright(p, down), i * levels * step) for i, p in enumerate(place[1:], 1)), F.shiftright(place[0], down))

    every = F.array(*[F.struct(F.lit(t).alias("level"), cell(t).alias("cell"), (cell(t - 1) if t > 1 else F.lit(0).cast("long")).alias("parent")) for t in range(1, levels + 1)])
    boxes = suppliers.groupBy("s", *rs).agg(F.count("*").alias("n")).select("s", *rs, "n", F.explode(every).alias("c")).groupBy("s", "c.level", "c.cell", "c.parent")
    boxes = kept(boxes.agg(F.sum("n").alias("n"), F.count("*").alias("vectors"), *[f(r).alias(f"{n}{i}") for i, r in enumerate(rs) for n, f in (("lo", F.min), ("hi", F.max))]))
    met = {r[0]: r[1] for r in boxes.groupBy("level").agg(F.sum(F.col("vectors") * F.col("vectors")) / F.sum("vectors")).collect()}  # a row for each level
    return next((t for t in range(1, levels) if met.get(t, 0) <= LEAF), levels), cell, boxes.drop("vectors")


def nearest_lists(points: DataFrame, suppliers: DataFrame, rs: list[str], cells: tuple[int, Callable[[int], Column], DataFrame]) -> DataFrame:
    """points with ``near``: the k nearest suppliers (gap, key, place) of the stratum, nearest first, ties by key; each point has its own k.

    All points go down cells within cells: those that surely hold k suppliers, the point's own first, bound the distance by their farthest corners, and a cell whose
    box is further away goes.
    """
    levels, cell, boxes = cells
    mine = Window.partitionBy("s", *rs)
    near = _square([F.greatest(F.lit(0.0), F.col(f"lo{i}") - F.col(r), F.col(r) - F.col(f"hi{i}")) for i, r in enumerate(rs)])
    far = _square([F.greatest(F.col(r) - F.col(f"lo{i}"), F.col(f"hi{i}") - F.col(r)) for i, r in enumerate(rs)])
    own = points.select("s", *rs, "k", F.explode(F.array(*[F.struct(F.lit(t).alias("level"), cell(t).alias("cell")) for t in range(1, levels + 1)])).alias("c")).select("s", *rs, "k", "c.*")
    own = own.join(boxes, ["s", "level", "cell"], "left").groupBy("s", *rs, "k").agg(F.min(F.when(F.col("n") >= F.col("k"), far)).alias("most"))
    front = own.select("s", *rs, "k", F.coalesce("most", F.lit(float("inf"))).alias("most"), F.lit(0).cast("long").alias("parent"))
    within = F.col("near") <= F.col("most") * (1 + 1e-9) + 1e-12  # what only rounding puts beyond the bound stays
    for t in range(1, levels + 1):
        inside = boxes.where(F.col("level") == t).drop("level")
        # the first level is a few cells for a stratum; joined by shuffle, it would put a stratum's points into one task
        met = front.join(F.broadcast(inside) if t == 1 else inside, ["s", "parent"])
        met = met.select("s", *rs, "k", "most", F.col("cell").alias("parent"), "n", near.alias("near"), far.alias("far")).where(within)
        met = met.withColumn("upto", F.sum("n").over(mine.orderBy("far").rowsBetween(Window.unboundedPreceding, 0)))
        met = met.withColumn("most", F.least("most", F.min(F.when(F.col("upto") >= F.col("k"), F.col("far"))).over(mine)))
        front = met.where(within).select("s", *rs, "k", "most", "parent")
    deepest = points.agg(F.max("k")).first()[0] or 0
    # of equal suppliers no more are met than a list can hold
    leaves = suppliers.withColumn("copy", F.row_number().over(mine.orderBy("key"))).where(F.col("copy") <= deepest)
    leaves = leaves.select("s", "key", "place", "copy", cell(levels).alias("parent"), *[F.col(r).alias(f"c_{r}") for r in rs])
    pairs = front.join(leaves, ["s", "parent"]).where(F.col("copy") <= F.col("k"))
    pairs = pairs.select("s", *rs, "k", _square([F.col(r) - F.col(f"c_{r}") for r in rs]).alias("gap"), "key", "place")
    first = pairs.withColumn("at", F.row_number().over(mine.orderBy("gap", "key"))).where(F.col("at") <= F.col("k"))
    lists = first.groupBy("s", *rs).agg(F.array_sort(F.collect_list(F.struct("gap", "key", "place"))).alias("near"))
    return points.join(lists, ["s", *rs])


Lists = list[tuple[list[int], list[float]]]  # of each point the suppliers and their costs, cheapest first


def cheapest(wants: list[int], lists: Lists, ends: list[float]) -> tuple[list[list[int]], list[bool]]:
    """The suppliers of each point in the cheapest assignment, and whether its list should be longer; if none should, it is the cheapest.

    What a point's list leaves out costs ``ends`` at least. Shortest augmenting paths from point to point; the end of a list stands for a supplier of its own,
    without limit. Where nobody gets that one, prices show that the assignment is the cheapest over all suppliers, listed or not.
    """
    u, v, owner, got, over = [0.0] * len(wants), {}, {}, [set() for _ in wants], [0] * len(wants)
    for start in (i for i, n in enumerate(wants) for _ in range(n)):
        reach, came, least, via, heap = {start: 0.0}, {}, {}, {}, []
        i, h, best, last = start, 0.0, math.inf, None
        while True:
            base = h - u[i]
            for j, c in zip(*lists[i], strict=True):
                if base + c >= best:
                    break  # prices are never above 0, and the rest costs more
                d = base + c - v.get(j, 0.0)
                if d < best and d < least.get(j, math.inf) and owner.get(j) not in reach:
                    least[j], via[j] = d, i
                    if j in owner:
                        heapq.heappush(heap, (d, j))
                    else:
                        best, last = d, j
            if base + ends[i] < best:
                best, last = base + ends[i], -1 - i
            while heap and (heap[0][0] > least[heap[0][1]] or owner[heap[0][1]] in reach):
                heapq.heappop(heap)
            if not heap or heap[0][0] >= best:
                break
            h, j = heapq.heappop(heap)
            i = owner[j]
            reach[i], came[i] = h, j
        for i, h in reach.items():
            u[i] += best - h
            for j in got[i]:
                v[j] = v.get(j, 0.0) + h - best
        i = via[last] if last >= 0 else -1 - last
        if last >= 0:
            owner[last] = i
            got[i].add(last)
        else:
            over[i] += 1
        while i != start:  # each point on the way gives away the supplier by which it was reached
            j = came[i]
            got[i].remove(j)
            i = owner[j] = via[j]
            got[i].add(j)
    # prices that come near the end of their list are likely to pass it next time
    return [sorted(js) for js in got], [any(over) and u[i] >= ends[i] / 2 for i in range(len(wants))]


def in_turn(turns: list[tuple[int, int]], near: list[list[int]], elsewhere: dict[int, int]) -> list[int]:
    """The supplier of each (seeker, point) of ``turns``, in order: the first on the point's list that no smaller seeker has, here or elsewhere; -1 at its end."""
    at, taken, out = [0] * len(near), set(), []
    for k, i in turns:
        ids, n = near[i], at[i]
        while n < len(ids) and (ids[n] in taken or elsewhere.get(ids[n], k) < k):
            n += 1
        at[i] = n
        out.append(ids[n] if n < len(ids) else -1)
        taken.add(out[-1])
    return out


CHOICE = "block long, at long, made int, place long, id long"


def _choose(points: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
    turns = sorted((k, i) for i, own in enumerate(points["seekers"]) for k in own.tolist())
    got = in_turn(turns, [ids.tolist() for ids in points["ids"]], dict(zip(held["id"].tolist(), held["holder"].tolist(), strict=True)))
    who = [i for _, i in turns]
    return pd.DataFrame({"block": points["block"].iloc[0], "at": points["at"].to_numpy()[who], "made": points["made"].to_numpy()[who], "place": [k for k, _ in turns], "id": got})


def _rounds(points: DataFrame, free: DataFrame, rs: list[str], ends: list[float]) -> DataFrame:
    """The supplier of each seeker, when rounds of choosing have come to rest."""
    spark = points.sparkSession
    levels, cell, _ = cells = _cells(free, rs, ends)
    points = placed(points, "at", "of", *[cell(t) for t in range(1, levels + 1)], *rs)
    points = points.withColumns({"block": F.floor(F.col("at") / BLOCK), "made": F.lit(0), "depth": F.lit(DEPTH)})

    def listed(points: DataFrame, suppliers: DataFrame, cells: tuple) -> DataFrame:
        points = kept(points.withColumn("k", F.col("depth") + 2 * F.size("seekers")))
        return nearest_lists(points, suppliers, rs, cells).select("s", *rs, "block", "at", "made", "depth", "seekers", F.col("near.place").alias("ids"))

    lists, made = cut(listed(points, free, cells)), 0
    choice, met = spark.createDataFrame([], CHOICE), spark.createDataFrame([], "id long, holder long")
    away = lists.select("block").distinct()
    while True:
        blocks = lists.select("block", F.explode("ids").alias("id")).groupBy("id").agg(F.collect_set("block").alias("blocks"))
        shared = cut(blocks.where(F.size("blocks") > 1).select("id", F.explode("blocks").alias("block")))
        if made:  # lists that are longer may share what somebody has
            met = _met(choice, shared)
        while not away.isEmpty():
            known = shared.join(met.select("id", "holder").distinct(), "id")
            mine, held = [df.join(F.broadcast(away), "block", "left_semi").groupBy("block") for df in (lists, known)]
            choice = cut(choice.join(F.broadcast(away), "block", "left_anti").unionByName(mine.cogroup(held).applyInPandas(_choose, CHOICE)))
            met = _met(choice, shared)
            away = met.where(F.col("place") > F.col("holder")).select("block").distinct()
        short = choice.where(F.col("id") < 0)
        if short.isEmpty():
            return choice
        made += 1
        away = short.select("block").distinct()
        told = cut(lists.join(short.groupBy("at", "made").agg(F.collect_list("place").alias("short")), ["at", "made"], "left"))
        stay = told.withColumn("seekers", F.array_except("seekers", F.coalesce("short", F.array().cast("array<bigint>")))).where(F.size("seekers") > 0)
        ask = told.where("short IS NOT NULL").groupBy("s", *rs, "block").agg(F.min("at").alias("at"), (WIDER * F.max("depth")).alias("depth"), F.sort_array(F.flatten(F.collect_list("short"))).alias("seekers"))
        least = ask.groupBy("s").agg(F.min(F.col("seekers")[0]).alias("least"))
        having = choice.where(F.col("id") >= 0).select(F.col("id").alias("place"), F.col("place").alias("holder"))
        open_to = free.join(F.broadcast(least), "s").join(having, "place", "left").where("holder IS NULL OR holder > least")
        open_to = kept(open_to.select(*free.columns))
        lists = cut(stay.drop("short").unionByName(listed(ask.withColumn("made", F.lit(made)), open_to, _cells(open_to, rs, ends))))


def _met(choice: DataFrame, shared: DataFrame) -> DataFrame:
    """Choices of suppliers that blocks share, with the smallest seeker that chose them."""
    return cut(choice.join(shared.select("id").distinct(), "id", "left_semi").select("block", "id", "place", F.min("place").over(Window.partitionBy("id")).alias("holder")))


def in_key_order(rows: DataFrame, rs: list[str], ends: list[float]) -> DataFrame:
    """s, key, with, gap: treated rows of a stratum, smallest key first, take the nearest control that is free; ``place`` counts rows by key.

    Points near each other are a block, and all blocks choose at once. Blocks with seekers whose control a smaller one chose too choose again, knowing who has
    the controls that blocks share, until nobody is turned away. As every control prefers the smaller key, the order of choosing changes nothing: that ends in
    the pairs of taking turns. Who comes to the end of a list gets another, of the controls that only larger seekers or none have. Where seekers are many,
    those first in order choose to the end before lists are made for the next.
    """
    rows = cut(rows.withColumn("id", F.monotonically_increasing_id()))
    gone, last = [F.log(x) / -math.log(1 - SHARE) for x in (F.col("c") / (F.col("c") - F.col("place")), F.greatest(F.lit(1.0), F.col("c") / FEW))]
    seekers = kept(rows.where(F.col("treated") & (F.col("place") < F.col("c"))).withColumn("batch", F.floor(F.least(gone, last))))
    controls = rows.where(~F.col("treated"))
    free = controls.select("s", *rs, F.col("place").alias("key"), F.col("id").alias("place"))
    pairs = rows.sparkSession.createDataFrame([], CHOICE)
    for b in range((seekers.agg(F.max("batch")).first()[0] or 0) + 1):
        points = seekers.where(F.col("batch") == b).groupBy("of", "s", *rs).agg(F.sort_array(F.collect_list("place")).alias("seekers"))
        choice = _rounds(points, free, rs, ends)
        free = cut(free.join(choice.select(F.col("id").alias("place")), "place", "left_anti"))
        pairs = pairs.unionByName(choice)
    controls = controls.select("id", "s", F.col("key").alias("with"), *[F.col(r).alias(f"c_{r}") for r in rs])
    met = pairs.join(controls, "id").join(seekers.select("s", "place", "key", *rs), ["s", "place"])
    return met.select("s", "key", "with", _square([F.col(r) - F.col(f"c_{r}") for r in rs]).alias("gap"))


def one_to_one(df: DataFrame, features: list[str], by: str, key: str, treated: str, optimal: bool = True) -> DataFrame:
    """Controls without replacement in each stratum: the cheapest assignment, or greedily in key order.

    Every treated row is returned; control and gap are null where controls ran out. Ties go to the smaller key. The side with fewer rows seeks (greedily, see
    ``in_key_order``: as many treated rows as there are controls). Equal seekers are one point with a list of its nearest suppliers, so the task of a stratum's
    cheapest assignment reads lists and not all its rows; where a list is too short for a certain choice, it is made four times as long and the stratum chooses again.
    """
    rs = [f"r{i}" for i in range(len(features))]
    z = standardized(df, features, by).select(F.col(by).alias("of"), F.struct(by).alias("s"), F.col(key).alias("key"), F.col(treated).alias("treated"), *[F.round(f"z_{f}", 9).alias(r) for f, r in zip(features, rs, strict=True)])
    z = kept(z)  # a struct is equal to another with a null in it
    sizes = z.groupBy("s").agg(F.count_if("treated").alias("t"), F.count_if(~F.col("treated")).alias("c"))
    # places break ties of the cheapest, far below any gap that is reported
    rows = kept(numbered(z.join(F.broadcast(sizes), "s"), "key", "place", "of", "treated"))
    spread = z.agg(*[F.min(r) for r in rs], *[F.max(r) for r in rs]).first()
    ends = [x or 0.0 for x in spread]
    if not optimal:
        pairs = in_key_order(rows, rs, ends).withColumnRenamed("with", "control")
        return z.where("treated").join(pairs, ["s", "key"], "left").select(F.col("of").alias(by), F.col("key").alias(key), "control", "gap")
    points = rows.where(F.col("treated") == (F.col("t") <= F.col("c"))).groupBy("of", "s", *rs).agg(F.sort_array(F.collect_list("key")).alias("seekers"))
    points = kept(points.withColumn("k", DEPTH + 2 * F.size("seekers")))
    suppliers = rows.where(F.col("treated") != (F.col("t") <= F.col("c"))).select("s", *rs, "key", "place")
    cells = _cells(suppliers, rs, ends)

    def choose(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("first").reset_index(drop=True)
        keys = np.unique(np.concatenate(pdf["keys"].tolist()))
        near = [np.searchsorted(keys, k) for k in pdf["keys"]]
        gaps = pdf["gaps"].tolist()
        beyond = [float(g[-1]) if len(g) >= k else math.inf for g, k in zip(gaps, pdf["k"], strict=True)]
        costs = [g + p * 1e-12 for g, p in zip(gaps, pdf["places"], strict=True)]
        orders = [np.argsort(c, kind="stable") for c in costs]
        got, short = cheapest([len(k) for k in pdf["seekers"]], [(j[o].tolist(), c[o].tolist()) for j, c, o in zip(near, costs, orders, strict=True)], beyond)
        out = []
        for i, own in enumerate(pdf["seekers"]):
            at = {j: n for n, j in enumerate(near[i].tolist())}
            chosen = sorted(at[j] for j in got[i])  # equal seekers take theirs in order of key, nearest first
            chosen += [None] * (len(own) - len(chosen))
            out += [(pdf["of"].iloc[i], *[pdf[r].iloc[i] for r in rs], k, None if n is None else keys[near[i][n]], None if n is None else float(gaps[i][n]), short[i]) for k, n in zip(own, chosen, strict=True)]
        return pd.DataFrame(out, columns=["of", *rs, "key", "with", "gap", "short"], dtype=object)

    kinds = dict(z.dtypes)
    schema = f"of {kinds['of']}, {', '.join(f'{r} double' for r in rs)}, key {kinds['key']}, with {kinds['key']}, gap double, short boolean"
    lists = kept(nearest_lists(points, suppliers, rs, cells))
    while True:
        found = lists.select("of", *rs, "k", "seekers", F.col("seekers")[0].alias("first"), F.col("near.key").alias("keys"), F.col("near.gap").alias("gaps"), F.col("near.place").alias("places"))
        found = kept(found.groupBy("of").applyInPandas(choose, schema).withColumn("s", F.struct(F.col("of").alias(by))))
        short = found.where("short").select("s", *rs).distinct()
        if short.isEmpty():
            break
        longer = lists.join(short, ["s", *rs], "left_semi").select("of", "s", *rs, "seekers", (4 * F.col("k")).alias("k"))
        lists = kept(lists.join(short, ["s", *rs], "left_anti").unionByName(nearest_lists(kept(longer), suppliers, rs, cells)))
    swapped = found.join(F.broadcast(sizes.where("t > c")), "s", "left_semi")
    pairs = found.join(F.broadcast(sizes.where("t > c")), "s", "left_anti")
    pairs = pairs.select("s", "key", F.col("with").alias("control"), "gap").unionByName(swapped.select("s", F.col("with").alias("key"), F.col("key").alias("control"), "gap"))
    return z.where("treated").join(pairs, ["s", "key"], "left").select(F.col("of").alias(by), F.col("key").alias(key), "control", "gap")
