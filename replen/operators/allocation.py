"""Cutting patterns and order shaping: every distinct demand of a model-color's sizes is met once, in one job."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from replen.operators.least_excess import Cover

#: Rows of a pattern set, a row for each pattern and size.
MOST_PATTERNS = 10_000


def size_priorities(sales: DataFrame) -> DataFrame:
    """Each size's share of its model-color's sales. sales: model, color, size, quantity."""
    total = F.sum("quantity").over(Window.partitionBy("model", "color"))
    rows = sales.groupBy("model", "color", "size").agg(F.sum("quantity").alias("quantity"))
    return rows.withColumn("priority", F.coalesce(F.try_divide(F.col("quantity"), total), F.lit(0.0)))


def drop_slow_sizes(demand: DataFrame, history: DataFrame, least: int) -> DataFrame:
    """Demand rows whose size sold `least` pieces or more; sizes without history stay. history: model, color, size, sold."""
    return demand.join(history, ["model", "color", "size"], "left").where(F.coalesce(F.col("sold") >= least, F.lit(True))).drop("sold")


def _excess(uses: dict[int, int], demand: dict[str, int], patterns: dict[int, dict[str, int]]) -> int | None:
    """Pieces made beyond the demand; None if some demand is left."""
    made: dict[str, int] = {}
    for p, n in uses.items():
        for s, k in patterns[p].items():
            made[s] = made.get(s, 0) + k * n
    if any(made.get(s, 0) < n for s, n in demand.items() if any(s in sizes for sizes in patterns.values())):
        return None
    return sum(n - demand.get(s, 0) for s, n in made.items() if n > demand.get(s, 0))


def _greedy(demand: dict[str, int], patterns: dict[int, dict[str, int]], mode: str) -> dict[int, int]:
    """Uses until no pattern meets any demand that is left; each step meets some, so it ends.

    `classic` takes the pattern that meets most, `overshoot` the one that meets most for the least excess. Ties go to the lower number.
    """
    left, uses = dict(demand), dict.fromkeys(patterns, 0)
    while True:
        gain = {}
        for p, sizes in patterns.items():
            met = sum(min(n, max(0, left.get(s, 0))) for s, n in sizes.items())
            if met:
                gain[p] = (met, -p) if mode == "classic" else (met - (sum(sizes.values()) - met), met, -p)
        if not gain:
            return uses
        p = max(gain, key=gain.get)
        times = max(1, min(left[s] // n for s, n in patterns[p].items() if left.get(s, 0) > 0))
        uses[p] += times
        for s, n in patterns[p].items():
            left[s] = left.get(s, 0) - n * times


def _trimmed(uses: dict[int, int], demand: dict[str, int], patterns: dict[int, dict[str, int]], least: int) -> dict[int, int]:
    """Uses under the least one raised to it, and those taken back that the demand does without."""
    uses = {p: max(n, least) if n else 0 for p, n in uses.items()}
    made = {s: sum(n.get(s, 0) * uses[p] for p, n in patterns.items()) for s in {*demand, *(s for n in patterns.values() for s in n)}}
    for p in sorted(patterns, reverse=True):
        spare = min((made[s] - demand.get(s, 0)) // n for s, n in patterns[p].items() if n)
        keep = max(0, uses[p] - max(0, spare))
        if 0 < keep < least:
            keep = min(least, uses[p])
        for s, n in patterns[p].items():
            made[s] -= n * (uses[p] - keep)
        uses[p] = keep
    return uses


def _positive(patterns: dict[int, dict[str, int]]) -> dict[int, dict[str, int]]:
    patterns = {p: {s: n for s, n in sizes.items() if n > 0} for p, sizes in patterns.items()}
    return {p: sizes for p, sizes in patterns.items() if sizes}


def cover(demand: dict[str, int], patterns: dict[int, dict[str, int]], least: int, mode: str = "least") -> dict[int, int]:
    """Uses of patterns that cover the demand, each pattern being used `least` times or not at all.

    `least` has the least excess of all (Cover.least_excess). `classic` and `overshoot` are greedy (see _greedy); `search` takes the
    better of both and goes on to replace one use of a pattern (all, if it has `least`) by uses of others, as long as the excess
    falls, which is quick for large dense pattern sets too. Sizes that no pattern has stay open.
    """
    patterns = _positive(patterns)
    if mode == "least":
        return Cover(patterns, least).least_excess(demand)
    demand = {s: n for s, n in demand.items() if n > 0}
    modes = ("overshoot", "classic") if mode == "search" else (mode,)
    found = [_trimmed(_greedy(demand, patterns, m), demand, patterns, least) for m in modes]
    best = min(found, key=lambda u: (_excess(u, demand, patterns), sum(u.values())))
    better = mode == "search"
    while better:
        better, now = False, (_excess(best, demand, patterns), sum(best.values()))
        for p in sorted(best):
            if not best[p]:
                continue
            fewer = {**best, p: best[p] - 1 if best[p] > least else 0}
            made: dict[str, int] = {}
            for q, n in fewer.items():
                for s, k in patterns[q].items():
                    made[s] = made.get(s, 0) + k * n
            rest = {s: n - made.get(s, 0) for s, n in demand.items() if n > made.get(s, 0)}
            others = {q: sizes for q, sizes in patterns.items() if q != p}
            more = _greedy(rest, others, "overshoot")
            tried = _trimmed({q: fewer[q] + more.get(q, 0) for q in patterns}, demand, patterns, least)
            excess = _excess(tried, demand, patterns)
            if excess is not None and (excess, sum(tried.values())) < now:
                best, better = tried, True
                break
    return best


def allocate(demand: DataFrame, patterns: DataFrame, least: int = 5, mode: str = "least") -> DataFrame:
    """model, color, pattern_id, uses covering the demand (model, color, size, quantity) by patterns (pattern_id, size, count).

    Each distinct demand of sizes is solved once and joined back. Missing sizes and quantities count as none; a model-color without any
    demand uses every pattern 0 times. The pattern set is small (some rows a pattern; over MOST_PATTERNS raise ValueError) and goes to
    the tasks as it is.
    """
    known: dict[int, dict[str, int]] = {}
    rows = patterns.orderBy("pattern_id", "size").limit(MOST_PATTERNS + 1).collect()
    if len(rows) > MOST_PATTERNS:
        raise ValueError(f"a pattern set has at most {MOST_PATTERNS} rows")
    for r in rows:
        if r["size"] is not None and r["count"] is not None:
            known.setdefault(r["pattern_id"], {})[str(r["size"])] = r["count"]
    known = _positive(known)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        solver = Cover(known, least) if mode == "least" else None
        for pdf in batches:
            for asked in pdf["asked"]:
                wanted = {x["size"]: x["quantity"] for x in json.loads(asked)}
                uses = solver.least_excess(wanted) if solver else cover(wanted, known, least, mode)
                yield pd.DataFrame({"asked": asked, "pattern_id": list(uses), "uses": list(uses.values())})

    met = F.col("size").isin(sorted({s for sizes in known.values() for s in sizes})) & (F.col("quantity") > 0)
    wanted = demand.groupBy("model", "color", "size").agg(F.sum("quantity").cast("long").alias("quantity"))
    size = F.struct(F.col("size").cast("string").alias("size"), "quantity")
    wanted = wanted.groupBy("model", "color").agg(F.to_json(F.sort_array(F.collect_list(F.when(met, size)))).alias("asked"))  # a model-color's sizes
    solved = wanted.select("asked").distinct().mapInPandas(run, "asked string, pattern_id int, uses long")
    return wanted.join(solved, "asked").select("model", "color", "pattern_id", "uses")


def produced(uses: DataFrame, patterns: DataFrame, demand: DataFrame) -> DataFrame:
    """model, color, size, required, produced, excess, covered."""
    made = uses.join(patterns, "pattern_id").groupBy("model", "color", "size").agg(F.sum(F.col("uses") * F.col("count")).alias("produced"))
    wanted = demand.groupBy("model", "color", "size").agg(F.sum("quantity").alias("required"))
    rows = made.join(wanted, ["model", "color", "size"], "full").fillna(0, ["produced", "required"])
    return rows.withColumns({"excess": F.greatest(F.lit(0), F.col("produced") - F.col("required")), "covered": F.col("produced") >= F.col("required")})


def violations(uses: DataFrame, least: int) -> DataFrame:
    return uses.where((F.col("uses") > 0) & (F.col("uses") < least))


def parity(uses: DataFrame) -> DataFrame:
    """Even numbers of uses only: odd ones are raised by one."""
    return uses.withColumn("uses", F.col("uses") + F.col("uses") % 2)


def cap_colors(colors: DataFrame) -> DataFrame:
    """Cut each color to its headroom (12-month sales less stock, 0 at least) and hand what is cut to the model's other colors
    in proportion to what they have left, best sellers first; colors without headroom go.

    colors: model, color, quantity, sales_12m, stock.
    """
    rows = colors.withColumn("cap", F.greatest(F.lit(0), F.floor(F.col("sales_12m") - F.col("stock"))))
    rows = rows.withColumn("kept", F.least("quantity", "cap")).withColumn("room", F.col("cap") - F.col("kept"))
    model = Window.partitionBy("model")
    order = model.orderBy(F.desc("sales_12m"), "color")
    cut, room = F.sum(F.col("quantity") - F.col("kept")).over(model), F.sum("room").over(model)
    given = F.least(cut, room)
    upto = F.sum("room").over(order.rowsBetween(Window.unboundedPreceding, 0))
    share = lambda r: F.coalesce(F.floor(F.try_divide(r * given, room)), F.lit(0))
    rows = rows.withColumn("extra", share(upto) - share(upto - F.col("room")))
    return rows.where("cap > 0").select("model", "color", "quantity", "cap", (F.col("kept") + F.col("extra")).cast("long").alias("capped"))


def scale_to_target(sizes: DataFrame, targets: DataFrame) -> DataFrame:
    """Scale each model-color's sizes to a target, one piece at least. targets: model, color, target."""
    total = F.sum("quantity").over(Window.partitionBy("model", "color"))
    rows = sizes.join(targets, ["model", "color"]).withColumn("scaled", F.bround(F.col("quantity") * F.try_divide(F.col("target"), total), 0))
    return rows.select("model", "color", "size", "quantity", F.greatest(F.lit(1), F.coalesce("scaled", F.lit(1))).cast("long").alias("scaled"))


def material_bounds(uses: DataFrame, least: int, most: int) -> DataFrame:
    """Bring each model's uses of a pattern over all colors between least and most, in proportion; the last color takes the remainder."""
    both = Window.partitionBy("model", "pattern_id")
    order = both.orderBy("color").rowsBetween(Window.unboundedPreceding, 0)
    rows = uses.withColumn("total", F.sum("uses").over(both))
    goal = F.when(F.col("total") == 0, 0).when(F.col("total") < least, least).when(F.col("total") > most, most).otherwise(F.col("total"))
    upto = lambda c: F.coalesce(F.floor(F.try_divide(c * goal, F.col("total"))), F.lit(0))
    rows = rows.withColumn("until", F.sum("uses").over(order))
    return rows.select("model", "color", "pattern_id", (upto(F.col("until")) - upto(F.col("until") - F.col("uses"))).cast("long").alias("uses"))


def children_shares(totals: DataFrame, color_sales: DataFrame, size_sales: DataFrame) -> DataFrame:
    """Spread each model's pieces over colors by sales and over sizes by sales. totals: model, total."""
    color = color_sales.withColumn("c", F.try_divide(F.col("quantity"), F.sum("quantity").over(Window.partitionBy("model")))).select("model", "color", "c")
    size = size_sales.withColumn("s", F.try_divide(F.col("quantity"), F.sum("quantity").over(Window.partitionBy("model")))).select("model", "size", "s")
    rows = totals.join(color, "model").join(size, "model")
    return rows.select("model", "color", "size", F.coalesce(F.bround(F.col("total") * F.col("c") * F.col("s"), 0), F.lit(0.0)).cast("long").alias("quantity"))


def production_table(uses: DataFrame, patterns: DataFrame, model: str, colors: list[str]) -> DataFrame:
    """Rows pattern and size, a column for each color, pattern uses as cells."""
    rows = uses.where(F.col("model") == model).join(patterns.select("pattern_id", "size"), "pattern_id")
    return rows.groupBy("pattern_id", "size").pivot("color", colors).agg(F.sum("uses"))


def constrain(demand: DataFrame, patterns: DataFrame, least: int = 5, colors: DataFrame | None = None, bounds: tuple[int, int] | None = None,
              even: bool = False, children: tuple[DataFrame, DataFrame, DataFrame] | None = None) -> DataFrame:
    """Pattern uses under the constraints that are given, in this order: color caps, bounds by material, even numbers, children's shares.

    colors: see cap_colors(); children: the arguments of children_shares(), whose models are then allocated anew.
    """
    if colors is not None:
        capped = cap_colors(colors).select("model", "color", F.col("capped").alias("target"))
        demand = scale_to_target(demand, capped.where("target > 0")).select("model", "color", "size", F.col("scaled").alias("quantity"))
    uses = allocate(demand, patterns, least)
    if bounds is not None:
        uses = material_bounds(uses, *bounds)
    if even:
        uses = parity(uses)
    if children is not None:
        spread = children_shares(*children)
        anew = allocate(spread, patterns, least)
        uses = uses.join(spread.select("model").distinct(), "model", "left_anti").unionByName(parity(anew) if even else anew)
    return uses
