"""Nearest point by great-circle distance, searched down a tree of cells.

Points stand on the unit sphere in a cube that is cut into cells, each level four times as finely in
each direction, so neither poles nor the longitude of 180 degrees are edges. A cell with few points
is a leaf, however coarse; a dense spot is cut on and on. Each cell knows the box of its points. A
query goes down all levels at once with those of its rows that can matter: a cell is left out if the
near side of its box lies farther away than the far side of another's. Then it is compared with the
points of the few leaves that are left. The number of steps follows the depth of the tree; tables of
cells are sent to all tasks where they are few, and then a query is not shuffled on the way down.
"""

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from waymark.functions.geo import haversine
from waymark.operators.joins import SMALL_ROWS
from waymark.session import written

#: Finest level: a cell there is some millimetres wide.
LEVELS = 16
#: Points up to which a cell is a leaf, and mean number in a cell at the level down to which all cells are counted.
LEAF, FILLING = 128, 16
#: Mean number of cells of a key that are all looked at, and points up to which cells of all levels are counted.
BEGIN, COUNTED = 64, 1 << 20
_AXES = ("x", "y", "z")
_NODE = ("level", "cell")


def unit_vector(lat: Column, lon: Column) -> Column:
    """Place on the unit sphere; half the squared distance of two is the haversine term, doubled."""
    y, x = F.radians(lat), F.radians(lon)
    return F.struct((F.cos(y) * F.cos(x)).alias("x"), (F.cos(y) * F.sin(x)).alias("y"), F.sin(y).alias("z"))


def _fine(u: Column) -> Column:
    """Cell of the finest level."""
    return F.struct(*[F.floor((u[c] + 1.0) * F.lit(4.0**LEVELS / 2)).alias(c) for c in _AXES])


def _up(cell: Column, levels: Column) -> Column:
    """The cell that many levels further up."""
    return F.struct(*[F.call_function("shiftright", cell[c], (levels * 2).cast("int")).alias(c) for c in _AXES])


def _cells(spots: DataFrame, first: int, last: int) -> DataFrame:
    """(_k, level, cell, n, box) of all cells of some levels that hold a point."""
    levels = spots.select("_k", "u", "fine", F.explode(F.sequence(F.lit(first), F.lit(last))).alias("level"))
    sides = [f(f"u.{c}").alias(f"{n}{c}") for c in _AXES for n, f in (("lo", F.min), ("hi", F.max))]
    return levels.withColumn("cell", _up(F.col("fine"), F.lit(LEVELS) - F.col("level"))).groupBy("_k", *_NODE).agg(F.count(F.lit(1)).alias("n"), *sides)


def _open(nodes: DataFrame) -> DataFrame:
    """Cells under a cell that is no leaf, and those of the first level."""
    above = nodes.where(F.col("n") > LEAF).select("_k", (F.col("level") + 1).alias("level"), F.col("cell").alias("_above"))
    below = nodes.where("level > 0").withColumn("_above", _up(F.col("cell"), F.lit(1)))
    return nodes.where("level = 0").unionByName(below.join(above, ["_k", "level", "_above"]).drop("_above"))


def _told(nodes: DataFrame) -> dict[int, tuple[int, int, int]]:
    """Per level its cells, leaves among them, and the most points in one."""
    rows = nodes.groupBy("level").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("n") <= LEAF).alias("leaves"), F.max("n").alias("most")).collect()
    return {r["level"]: (r["n"], r["leaves"], r["most"]) for r in rows}


def tree(points: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame, dict[int, int]]:
    """Cells (_k, level, cell, n, box, leaf), points (_k, level, cell, lat, lon, ord, value) by leaf, and how
    many cells each level has. Of points in one place only that with the least ord is kept."""
    spots = points.groupBy(*keys, "lat", "lon").agg(F.min_by(F.struct("ord", "value"), "ord").alias("_v"))
    spots = spots.select(F.struct(F.lit(0).alias("_"), *keys).alias("_k"), "lat", "lon", "_v.ord", "_v.value", unit_vector(F.col("lat"), F.col("lon")).alias("u"))
    spots = written(spots.withColumn("fine", _fine(F.col("u"))))
    total = spots.count()
    if total <= COUNTED:  # few enough to be counted on as many levels as a line of them needs
        depth = min(LEVELS, max(0, math.ceil(math.log(max(1, total) / FILLING, 4))) + 2)
    else:
        distinct = spots.agg(*[F.approx_count_distinct(F.struct("_k", _up(F.col("fine"), F.lit(LEVELS - v)))) for v in range(LEVELS + 1)]).first()
        depth = next((v for v, n in enumerate(distinct) if total <= FILLING * n), LEVELS)
    nodes = written(_open(_cells(spots, 0, depth)))
    told = _told(nodes)
    if depth < LEVELS and depth in told and told[depth][2] > LEAF:
        dense = nodes.where((F.col("level") == depth) & (F.col("n") > LEAF)).select("_k", "cell")
        deeper = spots.withColumn("cell", _up(F.col("fine"), F.lit(LEVELS - depth))).join(dense, ["_k", "cell"]).drop("cell")
        # the first of these levels stands for the one above in the look for open cells
        more = _open(nodes.where(F.col("level") == depth).unionByName(_cells(deeper, depth + 1, LEVELS))).where(F.col("level") > depth)
        nodes = written(nodes.unionByName(more))
        told = _told(nodes)
    last = max(told, default=0)
    nodes = nodes.withColumn("leaf", (F.col("n") <= LEAF) | (F.col("level") == last))
    ends = [v for v in told if told[v][1] or v == last]
    put = spots.withColumn("level", F.explode(F.sequence(F.lit(min(ends, default=0)), F.lit(max(ends, default=0))))).withColumn("cell", _up(F.col("fine"), F.lit(LEVELS) - F.col("level")))
    leaves = nodes.where("leaf").select("_k", *_NODE)
    few = sum(n for n, *_ in told.values()) <= SMALL_ROWS
    put = put.join(F.broadcast(leaves) if few else leaves, ["_k", *_NODE]).select("_k", *_NODE, "lat", "lon", "ord", "value")
    return nodes, put, {v: told[v][0] for v in sorted(told)}


def nearest(asked: DataFrame, points: DataFrame, keys: list[str] = ()) -> DataFrame:
    """(qid, qlat, qlng, keys, dist, ord, value) of the nearest point of its key for each distinct
    (qid, qlat, qlng, keys); a qid may be there more than once.

    points: (ord, lat, lon, keys, value). The lowest ord wins ties; a query whose key has no point
    has no row. Null keys are equal; coordinates must not be null.
    """
    keys = list(keys)
    nodes, spots, sizes = tree(points, keys)
    who = ["_q", "_k"]
    q = asked.select(F.struct("qid", "qlat", "qlng").alias("_q"), F.struct(F.lit(0).alias("_"), *keys).alias("_k")).distinct()
    small = sum(sizes.values()) <= SMALL_ROWS
    table = lambda df: F.broadcast(df) if small else df  # noqa: E731  a cell has a fixed number of columns
    u = unit_vector(F.col("_q.qlat"), F.col("_q.qlng"))
    gap = lambda c: F.greatest(F.lit(0.0), F.col(f"lo{c}") - u[c], u[c] - F.col(f"hi{c}"))
    reach = lambda c: F.greatest(F.abs(u[c] - F.col(f"lo{c}")), F.abs(u[c] - F.col(f"hi{c}")))
    total = lambda f: f("x") * f("x") + f("y") * f("y") + f("z") * f("z")
    box = [f"{n}{c}" for c in _AXES for n in ("lo", "hi")]

    def pruned(rows: DataFrame) -> DataFrame:
        """Rows of cells that may hold the nearest point; the margin is far beyond what rounding does."""
        best = F.min(total(reach)).over(Window.partitionBy(*who))
        return rows.withColumns({"_near": total(gap), "_best": best}).where(F.col("_near") <= F.col("_best") * 1.000001 + 1e-14).select(*who, *_NODE)

    # down to where a key has few cells all of them are looked at
    first = max((v for v in sizes if sizes[v] <= BEGIN * sizes[0]), default=0)
    top = (F.col("level") == first) | (F.col("level") < first) & F.col("leaf")
    state = pruned(q.join(table(nodes.where(top)), "_k"))
    for v in range(first + 1, len(sizes)):
        # the cells of this level under those above, and leaves found before under themselves
        below = nodes.where(F.col("level") == v).select("_k", F.struct(F.lit(v - 1).alias("level"), _up(F.col("cell"), F.lit(1)).alias("cell")).alias("_at"), *_NODE, *box)
        stay = nodes.where((F.col("level") < v) & F.col("leaf")).select("_k", F.struct(*_NODE).alias("_at"), *_NODE, *box)
        now = state.select(*who, F.struct(*_NODE).alias("_at"))
        state = pruned(now.join(table(below.unionByName(stay)), ["_k", "_at"]))
    dist = haversine(F.col("_q.qlat"), F.col("_q.qlng"), F.col("lat"), F.col("lon"))
    found = state.join(spots, ["_k", *_NODE]).withColumn("dist", dist)
    best = found.groupBy(*who).agg(F.min_by(F.struct("dist", "ord", "value"), F.struct("dist", "ord")).alias("_p"))
    return best.select("_q.*", *[F.col(f"_k.`{k}`").alias(k) for k in keys], "_p.*")
