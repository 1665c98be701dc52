"""Density clusters of places: eps-neighbours, at least ``min_samples`` points, the rest noise.

A core point has that many points, itself included, within eps; a cluster is a connected
component of the "no further than eps" graph of core points.  With two points enough for a
core, these are all points with a neighbour.  The graph is never written out pair by pair: points are
first merged into grid cells small enough that all points of a cell are neighbours,
so a crowded place is one node, and a node has a bounded number of neighbour cells.
Two cells are linked when their bounding boxes prove it; the few pairs the boxes
leave open are re-cut into finer cells, and only what is still open after that is
tested point by point.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayrisk.operators.ordering import matched, ordered_counts
from wayrisk.session import stored

_CUTS = [4, 32, 256]  # cells per eps at each refinement


def _cells(points: DataFrame, eps: float, cut: int) -> DataFrame:
    """Occupied cells of one cut: bounding box, smallest id, points; plus the coarser cell."""
    side = eps / cut
    return points.groupBy(
        *[c for c in points.columns if c in ("_node", "_parent")],
        F.floor(F.col("_lat") / side).alias("_i"),
        F.floor(F.col("_lng") / side).alias("_j"),
    ).agg(
        F.min("_id").alias("_cell"),
        F.count(F.lit(1)).alias("_n"),
        F.min("_lat").alias("_lat0"),
        F.max("_lat").alias("_lat1"),
        F.min("_lng").alias("_lng0"),
        F.max("_lng").alias("_lng1"),
    )


def _gap(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    return F.greatest(b0 - a1, a0 - b1, F.lit(0.0))


def _span(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    return F.greatest(a1, b1) - F.least(a0, b0)


def _judged(pairs: DataFrame, eps: float) -> DataFrame:
    """Keep box pairs that may hold neighbours; ``_sure`` where every pair of points is one."""
    a, b = (lambda c: F.col(f"a.{c}")), (lambda c: F.col(f"b.{c}"))
    lat, lng = ("_lat0", "_lat1"), ("_lng0", "_lng1")

    def square(measure) -> Column:
        x = measure(a(lat[0]), a(lat[1]), b(lat[0]), b(lat[1]))
        y = measure(a(lng[0]), a(lng[1]), b(lng[0]), b(lng[1]))
        return x * x + y * y

    limit = F.lit(eps * eps)
    return pairs.where(square(_gap) <= limit).withColumn("_sure", square(_span) <= limit)


def neighbour_links(points: DataFrame, eps: float) -> tuple[DataFrame, DataFrame]:
    """Nodes (merged points) and the links between them.

    ``points`` has ``_id, _lat, _lng``.  Nodes: ``_node, _n``; links: ``_a, _b`` with a < b.
    """
    first = _cells(points, eps, _CUTS[0])
    nodes = first.withColumns(
        {"_ci": F.floor(F.col("_i") / _CUTS[0]), "_cj": F.floor(F.col("_j") / _CUTS[0])}
    )
    around = F.explode(
        F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
    )
    left = (
        nodes.withColumn("_o", around)
        .withColumns({"_ci": F.col("_ci") + F.col("_o.i"), "_cj": F.col("_cj") + F.col("_o.j")})
        .drop("_o")
    )
    pairs = left.alias("a").join(
        nodes.alias("b"),
        (F.col("a._ci") == F.col("b._ci")) & (F.col("a._cj") == F.col("b._cj")) & (F.col("a._cell") < F.col("b._cell")),
    )
    judged = _judged(pairs, eps).select(
        F.col("a._cell").alias("_a"), F.col("b._cell").alias("_b"), "_sure"
    )
    links = judged.where("_sure").select("_a", "_b")
    # open: node pair plus the current sub-cells of either side
    open_pairs = judged.where(~F.col("_sure")).select(
        "_a", "_b", F.col("_a").alias("_pa"), F.col("_b").alias("_pb")
    )
    side = eps / _CUTS[0]
    placed = points.join(
        first.select("_i", "_j", F.col("_cell").alias("_parent")),
        (F.floor(F.col("_lat") / side) == F.col("_i")) & (F.floor(F.col("_lng") / side) == F.col("_j")),
    ).select("_id", "_lat", "_lng", "_parent")
    for cut in _CUTS[1:]:
        finer = _cells(placed, eps, cut)
        refined = open_pairs.join(finer.alias("a"), F.col("_pa") == F.col("a._parent")).join(
            finer.alias("b"), F.col("_pb") == F.col("b._parent")
        )
        judged = _judged(refined, eps).select(
            "_a", "_b", F.col("a._cell").alias("_pa"), F.col("b._cell").alias("_pb"), "_sure"
        )
        links = links.unionByName(judged.where("_sure").select("_a", "_b"))
        # a pair with one sure pair of sub-cells is linked: nothing of it stays open
        decided = judged.where("_sure").select("_a", "_b").distinct()
        open_pairs = stored(judged.where(~F.col("_sure")).drop("_sure").join(decided, ["_a", "_b"], "left_anti"))
        side = eps / cut
        placed = (
            placed.withColumns({"_i": F.floor(F.col("_lat") / side), "_j": F.floor(F.col("_lng") / side)})
            .join(finer.select("_parent", "_i", "_j", "_cell"), ["_parent", "_i", "_j"])
            .select("_id", "_lat", "_lng", F.col("_cell").alias("_parent"))
        )
    spots = placed.select("_parent", "_lat", "_lng").distinct()
    dx, dy = F.col("a._lat") - F.col("b._lat"), F.col("a._lng") - F.col("b._lng")
    tested = (
        open_pairs.join(spots.alias("a"), F.col("_pa") == F.col("a._parent"))
        .join(spots.alias("b"), F.col("_pb") == F.col("b._parent"))
        .where(dx * dx + dy * dy <= F.lit(eps * eps))
        .select("_a", "_b")
    )
    links = links.unionByName(tested).distinct()
    return nodes.select(F.col("_cell").alias("_node"), "_n"), links


def components(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """Smallest node of each node's connected component (``_node, _root``).

    Every round hooks each node onto its smallest neighbour, follows the hooks to their end
    by repeated doubling, and contracts the links to what is left between the ends.  A
    component loses at least half of its nodes every other round, whatever its shape; the
    rounds end when no link is left.  Every round is written as a table.
    """
    edges = stored(links.where("_a != _b").select("_a", "_b"))
    rounds = []
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("_b").alias("_a"), F.col("_a").alias("_b")))
        hooks = both.groupBy(F.col("_a").alias("_node")).agg(F.least("_node", F.min("_b")).alias("_root"))
        hooks = _followed(stored(hooks))
        rounds.append(hooks)
        a = hooks.select(F.col("_node").alias("_a"), F.col("_root").alias("_ra"))
        b = hooks.select(F.col("_node").alias("_b"), F.col("_root").alias("_rb"))
        edges = stored(
            edges.join(a, "_a").join(b, "_b").where("_ra != _rb").select(F.col("_ra").alias("_a"), F.col("_rb").alias("_b")).distinct()
        )
    ends = None  # where the nodes of a round end after all later rounds
    for hooks in reversed(rounds):
        ends = hooks if ends is None else stored(_hop(hooks, ends))
    if ends is None:
        return nodes.select("_node", F.col("_node").alias("_root"))
    return nodes.join(ends, "_node", "left").select("_node", F.coalesce("_root", "_node").alias("_root"))


def _hop(hooks: DataFrame, then: DataFrame) -> DataFrame:
    """``hooks`` with each root replaced by its own root in ``then``, if it has one there."""
    further = then.select(F.col("_node").alias("_root"), F.col("_root").alias("_end"))
    return hooks.join(further, "_root", "left").select("_node", F.coalesce("_end", "_root").alias("_root"))


def _followed(hooks: DataFrame) -> DataFrame:
    """Hooks to the end of each chain of hooks; every pass doubles the steps taken."""
    while True:
        further = hooks.select(F.col("_node").alias("_root"), F.col("_root").alias("_end"))
        moved = stored(hooks.join(further, "_root").select("_node", "_root", "_end"))
        settled = moved.where("_root != _end").isEmpty()
        hooks = moved.select("_node", F.col("_end").alias("_root"))
        if settled:
            return hooks


# --- any number of points ----------------------------------------------------
BOX = ["_lat0", "_lat1", "_lng0", "_lng1"]


def _levels(points: DataFrame, eps: float) -> list[DataFrame]:
    """Cells of every cut below each other (``_cell, _parent, _n`` and box), the places themselves last.

    The parent of the first level is the eps-sized cell (``_ci, _cj``).
    """
    place = lambda side: [F.floor(F.col("_lat") / side).alias("_i"), F.floor(F.col("_lng") / side).alias("_j")]
    first = _cells(points, eps, _CUTS[0])
    out = [first.select("_cell", "_n", *BOX, F.floor(F.col("_i") / _CUTS[0]).alias("_ci"), F.floor(F.col("_j") / _CUTS[0]).alias("_cj"))]
    placed = points.select("*", *place(eps / _CUTS[0])).join(first.select("_i", "_j", F.col("_cell").alias("_parent")), ["_i", "_j"]).select("_id", "_lat", "_lng", "_parent")
    for cut in _CUTS[1:]:
        finer = _cells(placed, eps, cut)
        out.append(finer.select("_cell", "_parent", "_n", *BOX))
        placed = placed.select("*", *place(eps / cut)).join(finer.select("_parent", "_i", "_j", "_cell"), ["_parent", "_i", "_j"]).select("_id", "_lat", "_lng", F.col("_cell").alias("_parent"))
    spots = placed.groupBy("_parent", "_lat", "_lng").agg(F.min("_id").alias("_cell"), F.count(F.lit(1)).alias("_n"))
    out.append(spots.select("_cell", "_parent", "_n", F.col("_lat").alias("_lat0"), F.col("_lat").alias("_lat1"), F.col("_lng").alias("_lng0"), F.col("_lng").alias("_lng1")))
    return [stored(level) for level in out]


def _measured(pairs: DataFrame) -> DataFrame:
    """Squares of the least and the largest distance of a point (``_lat, _lng``) to a box."""
    sides = [("_lat", "_lat0", "_lat1"), ("_lng", "_lng0", "_lng1")]
    gaps, spans = [], []
    for at, low, high in sides:
        gaps.append(F.greatest(F.col(low) - F.col(at), F.col(at) - F.col(high), F.lit(0.0)))
        spans.append(F.greatest(F.abs(F.col(at) - F.col(low)), F.abs(F.col(at) - F.col(high))))
    square = lambda parts: parts[0] * parts[0] + parts[1] * parts[1]
    return pairs.withColumns({"_least": square(gaps), "_most": square(spans)})


def _around(lonely: DataFrame, level: DataFrame, eps: float) -> DataFrame:
    """Each point beside the first-level cells of its eps-sized cell and the eight around it."""
    steps = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)]))
    # the eps-sized cell as the levels have it: from the first cut
    coarse = lambda c: F.floor(F.floor(F.col(c) / (eps / _CUTS[0])) / _CUTS[0])
    spread = lonely.withColumn("_o", steps).select("_id", "_lat", "_lng", (coarse("_lat") + F.col("_o.i")).alias("_ci"), (coarse("_lng") + F.col("_o.j")).alias("_cj"))
    return spread.join(level, ["_ci", "_cj"])


def neighbour_counts(lonely: DataFrame, levels: list[DataFrame], eps: float) -> DataFrame:
    """``_id, _near``: points of the levels within eps of each lonely point.

    A cell wholly within eps counts with its weight, one wholly beyond not at all; only cells the
    circle cuts are opened, so a crowded place is never listed point by point.
    """
    limit, parts = F.lit(eps * eps), []
    pairs = _around(lonely, levels[0], eps)
    for k, level in enumerate(levels):
        if k:
            pairs = pairs.join(level, "_parent")
        judged = _measured(pairs).where(F.col("_least") <= limit)
        parts.append(judged.where(F.col("_most") <= limit).groupBy("_id").agg(F.sum("_n").alias("_near")))
        pairs = stored(judged.where(F.col("_most") > limit).select("_id", "_lat", "_lng", F.col("_cell").alias("_parent")))
    total = parts[0]
    for part in parts[1:]:
        total = total.unionByName(part)
    return total.groupBy("_id").agg(F.sum("_near").alias("_near"))


def nearest(lonely: DataFrame, levels: list[DataFrame], eps: float) -> DataFrame:
    """``_id, _lat, _lng``: the place of the levels nearest to each lonely point within eps (of the smallest id if tied).

    Cells no point of which can be the nearest are dropped before the others are opened.
    """
    pairs = _around(lonely, levels[0], eps)
    for k, level in enumerate(levels):
        if k:
            pairs = pairs.join(level, "_parent")
        judged = stored(_measured(pairs).where(F.col("_least") <= F.lit(eps * eps)))
        best = judged.groupBy("_id").agg(F.min("_most").alias("_best"))
        pairs = judged.join(best, "_id").where(F.col("_least") <= F.col("_best"))
        if k < len(levels) - 1:
            pairs = pairs.select("_id", "_lat", "_lng", F.col("_cell").alias("_parent"))
    chosen = F.min_by(F.struct("_lat0", "_lng0"), F.struct("_least", "_cell")).alias("_to")
    return pairs.groupBy("_id").agg(chosen).select("_id", F.col("_to._lat0").alias("_lat"), F.col("_to._lng0").alias("_lng"))


def _cell_of(eps: float) -> list[Column]:
    side = eps / _CUTS[0]
    return [F.floor(F.col("_lat") / side).alias("_i"), F.floor(F.col("_lng") / side).alias("_j")]


def _clusters_of_cells(core: DataFrame, eps: float, least_size: int) -> DataFrame:
    """``_i, _j, cluster`` of the cells of core points, clusters numbered by smallest key; -1 below the size."""
    nodes, links = neighbour_links(core, eps)
    rooted = components(nodes, links).join(nodes, "_node")
    sizes = rooted.groupBy("_root").agg(F.sum("_n").alias("_size"))
    numbered = ordered_counts(
        sizes.where(F.col("_size") >= least_size).select("_root", F.lit(0).alias("_all")), ["_all"], "_root"
    ).select("_root", F.col("n_before").cast("int").alias("_number"))
    return (
        _cells(core, eps, _CUTS[0])
        .select("_i", "_j", F.col("_cell").alias("_node"))
        .join(rooted.select("_node", "_root"), "_node")
        .join(numbered, "_root", "left")
        .select("_i", "_j", F.coalesce(F.col("_number"), F.lit(-1)).alias("cluster"))
    )


def _dense_clusters(points: DataFrame, eps: float, min_samples: int) -> DataFrame:
    """``_id, cluster`` for any number of points a core needs."""
    cells = _cells(points, eps, _CUTS[0]).select("_i", "_j", F.col("_n").alias("_here"))
    placed = points.select("_id", "_lat", "_lng", *_cell_of(eps)).join(cells, ["_i", "_j"])
    # the points of a cell are neighbours: enough of them are all cores, and what is left is few a cell
    crowded = F.col("_here") >= min_samples
    lonely = stored(placed.where(~crowded).select("_id", "_lat", "_lng"))
    counts = stored(neighbour_counts(lonely, _levels(points, eps), eps))
    enough = counts.where(F.col("_near") >= min_samples).select("_id")
    core = stored(placed.where(crowded).select("_id", "_lat", "_lng").unionByName(lonely.join(enough, "_id", "left_semi").select("_id", "_lat", "_lng")))
    by_cell = stored(_clusters_of_cells(core, eps, 1))
    of_core = core.select("_id", *_cell_of(eps)).join(by_cell, ["_i", "_j"]).select("_id", "cluster")
    rest = stored(lonely.join(enough, "_id", "left_anti"))
    beside = nearest(rest, _levels(core, eps), eps).select("_id", *_cell_of(eps)).join(by_cell, ["_i", "_j"]).select("_id", "cluster")
    of_rest = rest.select("_id").join(beside, "_id", "left").select("_id", F.coalesce("cluster", F.lit(-1)).alias("cluster"))
    return of_core.unionByName(of_rest)


def density_clusters(
    df: DataFrame, key: str, lat: str = "station_lat", lng: str = "station_lng", eps: float = 0.01, min_samples: int = 2
) -> DataFrame:
    """Add ``cluster``: 0, 1, ... by smallest core key, -1 for noise, null without a place.

    A point that is no core but within eps of one belongs to its nearest core's cluster (the one of the
    smallest key if tied).  Keys are unique; a row without a key gets null.
    """
    points = df.where(F.col(lat).isNotNull() & F.col(lng).isNotNull() & F.col(key).isNotNull()).select(
        F.col(key).alias("_id"), F.col(lat).cast("double").alias("_lat"), F.col(lng).cast("double").alias("_lng")
    )
    points = stored(points)
    if min_samples == 2:  # every point with a neighbour is a core: no counts needed
        by_cell = _clusters_of_cells(points, eps, 2)
        found = points.select("_id", *_cell_of(eps)).join(by_cell, ["_i", "_j"]).select("_id", "cluster")
    else:
        found = _dense_clusters(points, eps, min_samples)
    return matched(df, found.select(F.col("_id").alias(key), "cluster"), [key], "left")
