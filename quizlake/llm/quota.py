"""Samples with given shares of categories.

The size of a plan is shared out to its categories in proportion to their shares, none below its minimum (or what it has)
and none above what it has. Every plan's quotas per category and stratum are then fractions; a maximum flow with lower
bounds makes them whole, so that each cell, each category and each stratum is off by less than one and the size is kept.
In each cell the rows with the smallest random keys are taken, exactly as many as the quota. A histogram of keys settles all
rows but those of one bucket per cell, so no cell is ever sorted as a whole. Plans and cells are tables throughout;
one plan's categories and strata are solved in one task, plan by plan.
"""

from __future__ import annotations

from math import ceil, floor

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quizlake.functions.matching import Flow
from quizlake.session import ready, stage

#: Buckets of keys, as bits: a cell's rows are settled by their buckets, but for those of one.
BUCKET_BITS = 14
_EPS = 1e-9
_QUOTAS = "plan_id int, categoria int, anio int, proporcion double, minimo long, necesarias long, disponibles long, alcanzables long, tamano long, cuota long"


def controlled_rounding(table: list[list[float]], totals: list[int] | None = None) -> list[list[int]]:
    """Whole numbers, each the floor or the ceiling of its cell, whose row and column sums are those of theirs, and whose sum stays.

    ``totals``: the rows' sums, where they are whole anyway. The sum of the table is whole. Such numbers always exist, as the
    table itself is a flow within these bounds.
    """
    base = [[floor(x + _EPS) for x in row] for row in table]
    rest = [[x - b if x - b > _EPS else 0.0 for x, b in zip(row, low)] for row, low in zip(table, base)]
    n, m = len(table), len(table[0]) if table else 0
    source, sink, start, end = range(n + m, n + m + 4)
    flow, need = Flow(n + m + 4), [0] * (n + m + 2)

    def bounded(a: int, b: int, x: float) -> None:
        low, high = floor(x + _EPS), ceil(x - _EPS)
        flow.edge(a, b, high - low)
        need[a] -= low
        need[b] += low

    for i, row in enumerate(rest):
        bounded(source, i, totals[i] - sum(base[i]) if totals else sum(row))
    cells = {(i, j): flow.edge(i, n + j, 1) for i in range(n) for j in range(m) if rest[i][j]}
    for j in range(m):
        bounded(n + j, sink, sum(row[j] for row in rest))
    whole = sum(totals) - sum(map(sum, base)) if totals else round(sum(map(sum, rest)))
    need[sink] -= whole
    need[source] += whole
    for v, x in enumerate(need):
        if x > 0:
            flow.edge(start, v, x)
        elif x < 0:
            flow.edge(v, end, -x)
    flow.run(start, end)
    for (i, j), e in cells.items():
        base[i][j] += flow.used(e)
    return base


def share_out(size: float, shares: list[float], least: list[int], most: list[int]) -> list[float]:
    """Numbers in proportion to ``shares``, but none below ``least`` nor above ``most``, that sum to ``size`` (within their sums)."""
    at = lambda k: [min(max(k * p, lo), max(lo, hi)) for p, lo, hi in zip(shares, least, most)]
    steps = sorted({b / p for p, lo, hi in zip(shares, least, most) if p > 0 for b in (lo, max(lo, hi))})
    below = [k for k in steps if sum(at(k)) <= size]
    above = [k for k in steps if sum(at(k)) > size]
    low = below[-1] if below else 0.0
    if not above:
        return [float(x) for x in at(low)]
    # Between two steps the sum is a straight line.
    a, b = sum(at(low)), sum(at(above[0]))
    return at(low + (size - a) * (above[0] - low) / (b - a))


def reachable(need: list[int], cells: list[list[int]]) -> list[int]:
    """What each category can give of its need, by a maximum flow from the needs through the cells' rows."""
    n, m = len(need), len(cells[0]) if cells else 0
    flow = Flow(n + m + 2)
    edges = [flow.edge(n + m, i, x) for i, x in enumerate(need)]
    for i, row in enumerate(cells):
        for j, x in enumerate(row):
            if x:
                flow.edge(i, n + j, x)
    for j in range(m):
        flow.edge(n + j, n + m + 1, sum(row[j] for row in cells))
    flow.run(n + m, n + m + 1)
    return [flow.used(e) for e in edges]


def category_of(text: Column, names: Column) -> Column:
    """The number of a category written as a number or by its name (``names``: a map), in any case and padding; null if it is neither."""
    plain = F.lower(F.regexp_replace(text, r"(?U)^\s+|\s+$", ""))
    return F.coalesce(plain.try_cast("int"), F.try_element_at(names, plain))


def plans(cuotas: DataFrame) -> DataFrame:
    """(plan_id, comunidad, categoria, tamano, proporcion, n_objetivo, minimo): one row per plan and category.

    Rows without plan or category are left out; null and negative numbers count as 0, a null or missing size as none. Of
    several rows for one plan and category the largest demands hold, of several sizes or places the largest and the first.
    """
    for c, kind in (("tamano", "int"), ("proporcion", "double")):
        if c not in cuotas.columns:
            cuotas = cuotas.withColumn(c, F.lit(None).cast(kind))
    rows = cuotas.where(F.col("plan_id").isNotNull() & F.col("categoria").isNotNull())
    whole = Window.partitionBy("plan_id")
    rows = rows.select("plan_id", F.min("comunidad").over(whole).alias("comunidad"), "categoria", F.max("tamano").over(whole).alias("tamano"), "proporcion", "n_objetivo", "minimo")
    positive = lambda c: F.greatest(F.coalesce(F.max(c), F.lit(0)), F.lit(0)).alias(c)
    return rows.groupBy("plan_id", "comunidad", "categoria").agg(F.max("tamano").alias("tamano"), *map(positive, ("proporcion", "n_objetivo", "minimo")))


def categorised(preguntas: DataFrame, cuotas: DataFrame, seed: int) -> DataFrame:
    """(num, community, anio, cat, _key, _bucket): ``categoria`` read first, else ``categoria_nombre``; rows with neither are left out."""
    named = cuotas.where("categoria is not null and nombre is not null").groupBy(F.lower(F.regexp_replace("nombre", r"(?U)^\s+|\s+$", "")).alias("n")).agg(F.min("categoria").cast("int").alias("c"))
    names = named.select(F.map_from_entries(F.collect_list(F.struct("n", "c")))).scalar()  # as many entries as categories have names
    rows = preguntas.select("num", "community", "anio", F.coalesce(category_of(F.col("categoria"), names), category_of(F.col("categoria_nombre"), names)).alias("cat"))
    key = F.xxhash64(F.lit(seed), "num")
    return rows.where(F.col("cat").isNotNull()).withColumn("_key", key).withColumn("_bucket", F.shiftrightunsigned("_key", 64 - BUCKET_BITS))


def _within(counted: DataFrame, planned: DataFrame) -> DataFrame:
    """``counted`` (community, cat, ...) with the plans whose category and place they are in."""
    place = F.col("comunidad").isNull() | (F.col("comunidad") == F.col("community"))
    return counted.join(planned, (F.col("cat") == F.col("categoria")) & place)


def _solve(key: tuple, wanted: pd.DataFrame, there: pd.DataFrame) -> pd.DataFrame:
    wanted = wanted.sort_values("categoria")
    have: dict[int, dict] = {}
    for c, y, n in zip(there["cat"], there["anio"], there["n"]):
        have.setdefault(int(c), {})[None if pd.isna(y) else int(y)] = int(n)
    strata = sorted({y for per in have.values() for y in per}, key=lambda y: (y is None, y or 0)) or [None]
    cats = [int(c) for c in wanted["categoria"]]
    cells = [[have.get(c, {}).get(y, 0) for y in strata] for c in cats]
    total = [sum(row) for row in cells]
    target, least_wanted, share = ([x for x in wanted[c]] for c in ("n_objetivo", "minimo", "proporcion"))
    need = [int(max(t, lo)) for t, lo in zip(target, least_wanted)]
    share = [p if p > _EPS else 0.0 for p in share]  # less than one in a billion is none
    size = wanted["tamano"].iloc[0]
    if pd.isna(size):
        amounts = [float(min(x, a)) for x, a in zip(need, total)]
    else:
        if not any(share):
            share = [float(t) for t in target]
        least = [int(min(lo, a)) for lo, a in zip(least_wanted, total)]
        most = [a if p > 0 else lo for a, p, lo in zip(total, share, least)]
        amounts = share_out(max(sum(least), min(int(size), sum(most))), share, least, most)
    table = [[x * n / a if a else 0.0 for n in row] for x, row, a in zip(amounts, cells, total)]
    quotas, reached = controlled_rounding(table), reachable(need, cells)
    drawn = sum(map(sum, quotas))
    rows = [(key[0], c, y, float(p), int(lo), w, a, r, drawn, q) for c, p, lo, w, a, r, row in zip(cats, share, least_wanted, need, total, reached, quotas) for y, q in zip(strata, row) if q or y == strata[0]]
    return pd.DataFrame(rows, columns=[f.split()[0] for f in _QUOTAS.split(", ")]).astype({"anio": "Int32"})


def allocate(counted: DataFrame, planned: DataFrame) -> DataFrame:
    """The staged quotas: a row per plan, category and stratum (one per category at least), see ``_QUOTAS``.

    ``tamano`` is what the plan draws, ``necesarias`` the larger of a category's target and minimum, ``alcanzables`` what it can
    give of them. A plan is solved in one task: its table has a cell per category and year.
    """
    ready(counted.sparkSession)
    places = planned.select(F.col("plan_id").alias("plan_id"), "comunidad", F.col("categoria").alias("categoria"))
    there = _within(counted, places).groupBy(F.col("plan_id").alias("_plan"), "cat", "anio").agg(F.sum("n").alias("n"))
    return stage(planned.groupBy("plan_id").cogroup(there.groupBy("_plan")).applyInPandas(_solve, _QUOTAS), "quotas")


def _quotas(preguntas: DataFrame, cuotas: DataFrame, seed: int) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(rows, histogram of their keys per place, category and year, plans, staged quotas)."""
    rows = categorised(preguntas, cuotas, seed)
    counted = stage(rows.groupBy("community", "cat", "anio", "_bucket").agg(F.count(F.lit(1)).alias("n")), "histogram")
    planned = plans(cuotas)
    return rows, counted, planned, allocate(counted, planned)


def report(preguntas: DataFrame, cuotas: DataFrame, seed: int = 42) -> DataFrame:
    """(plan_id, categoria, necesarias, disponibles, alcanzables, faltan) for every plan and category, from the solved plans."""
    quotas = _quotas(preguntas, cuotas, seed)[3]
    ids = [F.col(c).cast("bigint").alias(c) for c in ("plan_id", "categoria")]
    one = quotas.select(*ids, "necesarias", "disponibles", "alcanzables").distinct()
    return one.withColumn("faltan", F.col("necesarias") - F.col("alcanzables"))


def shares(preguntas: DataFrame, cuotas: DataFrame, seed: int = 42) -> DataFrame:
    """(plan_id, categoria, proporcion, minimo, tamano, tomadas, alcanzada, desvio): the share wanted and the share drawn.

    ``alcanzada`` is the category's part of what the plan draws, null if that is nothing; ``desvio`` is by how much it differs.
    """
    quotas = _quotas(preguntas, cuotas, seed)[3]
    per = quotas.groupBy("plan_id", "categoria").agg(F.max("proporcion").alias("proporcion"), F.max("minimo").alias("minimo"), F.max("tamano").alias("tamano"), F.sum("cuota").alias("tomadas"))
    reached = F.when(F.col("tamano") > 0, F.col("tomadas") / F.col("tamano"))
    return per.withColumn("alcanzada", reached).withColumn("desvio", F.col("alcanzada") - F.col("proporcion"))


def unmet(preguntas: DataFrame, cuotas: DataFrame) -> DataFrame:
    """(plan_id, categoria) of the categories that cannot give what a plan needs of them, as its flow shows."""
    return report(preguntas, cuotas).where("faltan > 0").select("plan_id", "categoria")


def sample(preguntas: DataFrame, cuotas: DataFrame, seed: int = 42) -> DataFrame:
    """(plan_id, num, categoria): for every plan a sample without replacement that fills each cell's quota exactly.

    The key of a row depends on seed and ``num`` only, so a sample is repeatable, and plans draw the same rows first. Equal keys
    go by ``num``; rows with equal ``num`` count one by one. A row meets the limits of its cell once, and is given to plans
    only if its bucket is within theirs.
    """
    rows, counted, planned, quotas = _quotas(preguntas, cuotas, seed)
    cell = ["plan_id", "cat", "anio"]
    wanted = quotas.where("cuota > 0").select("plan_id", F.col("categoria").alias("cat"), "anio", "cuota")
    places = planned.select("plan_id", "comunidad", "categoria")
    counts = _within(counted, places).groupBy(*cell, "_bucket").agg(F.sum("n").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy(*cell).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    meet = lambda a, b: (F.col(f"{a}.plan_id") == F.col(f"{b}.plan_id")) & (F.col(f"{a}.cat") == F.col(f"{b}.cat")) & F.col(f"{a}.anio").eqNullSafe(F.col(f"{b}.anio"))
    limits = counts.withColumn("_before", before).alias("c").join(wanted.alias("q"), meet("q", "c")).where((F.col("_before") < F.col("cuota")) & (F.col("_before") + F.col("n") >= F.col("cuota")))
    limits = limits.select("c.plan_id", "c.cat", "c.anio", F.col("_bucket").alias("_last"), (F.col("cuota") - F.col("_before")).alias("_rest"))
    # The limits of all plans that a place, category and year is in; as many entries as there are plans.
    here = _within(counted.select("community", "cat", "anio").distinct(), places).alias("h").join(limits.alias("l"), meet("h", "l"))
    here = here.groupBy(F.col("h.community").alias("_c"), F.col("h.cat").alias("_k"), F.col("h.anio").alias("_y")).agg(F.collect_list(F.struct("h.plan_id", "_last", "_rest")).alias("_plans"))
    joined = rows.join(here, F.col("community").eqNullSafe(F.col("_c")) & (F.col("cat") == F.col("_k")) & F.col("anio").eqNullSafe(F.col("_y")))
    given = joined.select("num", "cat", "anio", "_key", "_bucket", F.inline(F.filter("_plans", lambda p: F.col("_bucket") <= p["_last"])))
    sure = given.where(F.col("_bucket") < F.col("_last")).select("plan_id", "num", F.col("cat").alias("categoria"))
    edge = given.where(F.col("_bucket") == F.col("_last")).groupBy(*cell, "_key", "num", "_rest").agg(F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy(*cell).orderBy("_key", "num").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    taken = edge.withColumn("_take", F.least("_n", F.col("_rest") - before)).where("_take > 0")
    return sure.unionByName(taken.select("plan_id", "num", F.col("cat").alias("categoria"), F.explode(F.sequence(F.lit(1), F.col("_take").cast("int"))).alias("_i")).drop("_i"))
