"""Grids, polygon areas and area weights in a cylindrical equal-area projection.

The projection is closed-form column math (WGS84 ellipsoid, standard parallel 30 degrees), so
projecting is a column expression, and areas and their shares of cells are sums over edges.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelspark.functions.columns import digest_int, ratio

# WGS84 and the standard parallel of the equal-area grid.
A = 6378137.0
E2 = 0.00669437999014133
E1 = math.sqrt(E2)
PARALLEL = math.radians(30.0)
K0 = math.cos(PARALLEL) / math.sqrt(1 - E2 * math.sin(PARALLEL) ** 2)
Q_POLE = (1 - E2) * (1 / (1 - E2) - (1 / (2 * E1)) * math.log((1 - E1) / (1 + E1)))


def project_x(lon: Column) -> Column:
    return F.radians(lon) * F.lit(A * K0)


def authalic_q(lat: Column) -> Column:
    s = F.sin(F.radians(lat))
    return F.lit(1 - E2) * (
        s / (1 - F.lit(E2) * s * s)
        - F.lit(1 / (2 * E1)) * F.log((1 - F.lit(E1) * s) / (1 + F.lit(E1) * s))
    )


def project_y(lat: Column) -> Column:
    return authalic_q(lat) * F.lit(A / (2 * K0))


def unproject_lon(x: Column) -> Column:
    return F.degrees(x / F.lit(A * K0))


def unproject_lat(y: Column) -> Column:
    """Inverse of :func:`project_y` by the authalic-latitude series."""
    beta = F.asin(y * F.lit(2 * K0 / (A * Q_POLE)))
    e4, e6 = E2**2, E2**3
    return F.degrees(
        beta
        + F.lit(E2 / 3 + 31 * e4 / 180 + 517 * e6 / 5040) * F.sin(beta * 2)
        + F.lit(23 * e4 / 360 + 251 * e6 / 3780) * F.sin(beta * 4)
        + F.lit(761 * e6 / 45360) * F.sin(beta * 6)
    )


def grid_index_range(lo: Column, hi: Column, resolution: float) -> tuple[Column, Column]:
    """First and last cell number that cover [lo, hi], snapped outward by half a cell."""
    half = resolution / 2
    return (
        F.floor((lo - half) / resolution).cast("long"),
        F.ceil((hi + half) / resolution).cast("long"),
    )


def cell_columns(row: str, col: str, resolution: float) -> dict[str, Column]:
    lat, lon = F.col(row) * F.lit(resolution), F.col(col) * F.lit(resolution)
    return {
        "cell_id": F.format_string("%.4f,%.4f", lat, lon),
        "lat": F.round(lat, 6),
        "lon": F.round(lon, 6),
    }


def native_grid(bounds: DataFrame, resolution: float) -> DataFrame:
    """Cells covering one row of bounds; integer indices, so no rounding drift accumulates."""
    r0, r1 = grid_index_range(F.col("min_lat"), F.col("max_lat"), resolution)
    c0, c1 = grid_index_range(F.col("min_lon"), F.col("max_lon"), resolution)
    return (
        bounds.select(F.sequence(r0, r1).alias("rows"), F.sequence(c0, c1).alias("cols"))
        .select(F.explode("rows").alias("cell_row"), "cols")
        .select("cell_row", F.explode("cols").alias("cell_col"))
        .withColumns(cell_columns("cell_row", "cell_col", resolution))
    )


def overall_bounds(boxes: DataFrame) -> DataFrame:
    return boxes.agg(
        F.min("min_lon").alias("min_lon"),
        F.min("min_lat").alias("min_lat"),
        F.max("max_lon").alias("max_lon"),
        F.max("max_lat").alias("max_lat"),
    )


def touched_cells(boxes: DataFrame, resolution: float) -> DataFrame:
    """Each box with the grid cells its bounding box may touch: an explode, not a join."""
    r0, r1 = grid_index_range(F.col("min_lat"), F.col("max_lat"), resolution)
    c0, c1 = grid_index_range(F.col("min_lon"), F.col("max_lon"), resolution)
    return (
        boxes.withColumn("cell_row", F.explode(F.sequence(r0, r1)))
        .withColumn("cell_col", F.explode(F.sequence(c0, c1)))
        .withColumns(cell_columns("cell_row", "cell_col", resolution))
    )


def box_area_weights(boxes: DataFrame, resolution: float, *, entity: str = "entity_id") -> DataFrame:
    """Share of each box's equal-area surface that lies in each cell; positive shares only."""
    half = resolution / 2
    t = touched_cells(boxes, resolution)
    lat, lon = F.col("cell_row") * F.lit(resolution), F.col("cell_col") * F.lit(resolution)
    west, east = F.greatest("min_lon", lon - half), F.least("max_lon", lon + half)
    south, north = F.greatest("min_lat", lat - half), F.least("max_lat", lat + half)
    width = F.greatest(F.lit(0.0), project_x(east) - project_x(west))
    height = F.greatest(F.lit(0.0), project_y(north) - project_y(south))
    total = (project_x(F.col("max_lon")) - project_x(F.col("min_lon"))) * (
        project_y(F.col("max_lat")) - project_y(F.col("min_lat"))
    )
    return (
        t.withColumn("intersection_area_m2", width * height)
        .withColumn("entity_area_m2", total)
        .filter((east > lon - half) & (west < lon + half) & (F.col("intersection_area_m2") > 0))
        .select(
            entity,
            "cell_id",
            "lat",
            "lon",
            "intersection_area_m2",
            "entity_area_m2",
            (F.col("intersection_area_m2") / F.col("entity_area_m2")).alias("weight"),
        )
    )


def _parts(rings: DataFrame, entity: str) -> DataFrame:
    """Rings as closed arrays of projected points, with the sign their surface counts with.

    A row is one ring; an entity may have several, and rows whose ``hole`` is true are cut out. Rings may
    run either way round and need not repeat their first vertex.
    """
    hole = F.coalesce(F.col("hole"), F.lit(False)) if "hole" in rings.columns else F.lit(False)
    ends_meet = F.get("ring", F.lit(0)) == F.get("ring", F.size("ring") - 1)
    points = F.transform(
        F.when(ends_meet, F.col("ring")).otherwise(F.concat("ring", F.slice("ring", 1, 1))),
        lambda p: F.struct(project_x(p["lon"]).alias("x"), project_y(p["lat"]).alias("y"), p["lon"].alias("lon")),
    )
    some = rings.filter(F.size("ring") > 0).select(entity, F.when(hole, -1.0).otherwise(1.0).alias("_sign"), points.alias("_p"))
    edges = F.zip_with(F.expr("slice(_p, 1, greatest(size(_p) - 1, 0))"), F.expr("slice(_p, 2, greatest(size(_p) - 1, 0))"), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    return some.select(entity, "_sign", F.get("_p", F.lit(0)).alias("_o"), edges.alias("_e"))


def _shoelace() -> dict[str, Column]:
    """Twice the signed area of a ring and its first moments, relative to the ring's first vertex."""
    zero = F.struct(*[F.lit(0.0).alias(n) for n in ("c", "sx", "sy")])

    def add(total: Column, e: Column) -> Column:
        ax, ay, bx, by = (e[k][v] - F.col("_o")[v] for k, v in (("a", "x"), ("a", "y"), ("b", "x"), ("b", "y")))
        cross = ax * by - bx * ay
        return F.struct(
            (total["c"] + cross).alias("c"), (total["sx"] + (ax + bx) * cross).alias("sx"), (total["sy"] + (ay + by) * cross).alias("sy")
        )

    return {"_s": F.aggregate("_e", zero, add)}


def ring_area_centroid(rings: DataFrame, *, entity: str = "entity_id") -> DataFrame:
    """Equal-area surface (km2) and centroid of areas of one or more rings, holes cut out.

    Each ring gives its area and moments within its row; the rings of an entity are sums. Rings of one
    entity must not overlap. An area without surface has a null centroid.
    """
    ring = _parts(rings, entity).withColumns(_shoelace()).select(entity, "_sign", "_o", "_s.*")
    turn = F.col("_sign") * F.signum("c")
    area = turn * F.col("c") / 2.0
    sums = ring.groupBy(entity).agg(
        F.sum(area).alias("a"),
        F.sum(area * F.col("_o.x") + turn * F.col("sx") / 6.0).alias("mx"),
        F.sum(area * F.col("_o.y") + turn * F.col("sy") / 6.0).alias("my"),
    )
    return sums.select(
        entity,
        (F.col("a") / 1_000_000.0).alias("area_km2"),
        unproject_lat(ratio("my", "a")).alias("centroid_lat"),
        unproject_lon(ratio("mx", "a")).alias("centroid_lon"),
    )


# Shares of a cell below this are rounding noise of the sums.
SLIVER = 1e-9


def ring_area_weights(rings: DataFrame, resolution: float, *, entity: str = "entity_id") -> DataFrame:
    """Share of each area's equal-area surface in each cell, for areas of any number of rings and holes.

    The surface inside a cell is a sum over edges: an edge adds the strip between it and the cell's lower
    side (the whole height where it runs above the cell), rightward edges against leftward ones. So an edge is
    one row per column and row of cells that it touches, sums need no vertices side by side, and a coast of millions
    of vertices is pre-aggregated like any other sum. What an edge adds to all cells below comes from a
    running sum down each column of cells, which also gives the cells that no edge touches.
    """
    half = resolution / 2
    parts = _parts(rings, entity).withColumns(_shoelace())
    edges = parts.select(entity, (-F.col("_sign") * F.signum("_s.c")).alias("turn"), F.explode("_e").alias("e"))
    edges = edges.select(entity, "turn", F.col("e.a.x").alias("xa"), F.col("e.a.y").alias("ya"), F.col("e.b.x").alias("xb"), F.col("e.b.y").alias("yb"), F.col("e.a.lon").alias("la"), F.col("e.b.lon").alias("lb"))
    index = lambda degrees, slack: F.floor(degrees / resolution + 0.5 + slack).cast("long")
    tolerance = 1e-6
    cut = edges.filter("xa <> xb").withColumn(
        "cell_col", F.explode(F.sequence(index(F.least("la", "lb"), -tolerance), index(F.greatest("la", "lb"), tolerance)))
    )
    lon = F.col("cell_col") * F.lit(resolution)
    held = lambda x: F.least(F.greatest(F.col(x), project_x(lon - half)), project_x(lon + half))
    at = lambda x: F.col("ya") + (F.col("yb") - F.col("ya")) * ((x - F.col("xa")) / (F.col("xb") - F.col("xa")))
    cut = cut.select(entity, "cell_col", "turn", (held("xb") - held("xa")).alias("dx"), at(held("xa")).alias("y0"), at(held("xb")).alias("y1"))
    cut = cut.filter("dx <> 0").select(entity, "cell_col", (F.col("turn") * F.col("dx")).alias("dx"), F.least("y0", "y1").alias("lo"), F.greatest("y0", "y1").alias("hi"))
    first = index(unproject_lat(F.col("lo")), -tolerance)
    rows = cut.withColumn("_first", first).withColumn("cell_row", F.explode(F.sequence("_first", index(unproject_lat(F.col("hi")), tolerance))))
    lat = F.col("cell_row") * F.lit(resolution)
    south, north = project_y(lat - half), project_y(lat + half)
    rows = rows.withColumns({"s": south, "n": north})
    into = lambda y: F.least(F.greatest(F.col(y), F.col("s")), F.col("n"))
    # Mean height above the cell's lower side: the part of the edge inside the cell, and the part above it.
    inside = (into("hi") - into("lo")) * ((into("hi") + into("lo")) / 2 - F.col("s"))
    above = (F.col("hi") - F.least("hi", F.greatest("lo", "n"))) * (F.col("n") - F.col("s"))
    height = F.when(F.col("hi") > F.col("lo"), (inside + above) / (F.col("hi") - F.col("lo"))).otherwise(into("lo") - F.col("s"))
    sums = rows.groupBy(entity, "cell_col", "cell_row").agg(
        F.sum(F.col("dx") * height).alias("own"), F.sum(F.when(F.col("cell_row") == F.col("_first"), F.col("dx")).otherwise(0.0)).alias("over")
    )
    down = Window.partitionBy(entity, "cell_col").orderBy(F.desc("cell_row"))
    # The width of surface that reaches into the cells below this one, and the next cell below that edges touch.
    column = sums.withColumns({"below": F.sum("over").over(down), "next_row": F.lead("cell_row").over(down)})
    column = column.withColumn("above", F.col("below") - F.col("over"))
    gap = F.expr("CASE WHEN next_row < cell_row - 1 THEN sequence(cell_row - 1, next_row + 1, -1) ELSE array() END")
    cells = column.select(
        entity, "cell_col",
        F.explode(F.concat(F.array(F.struct("cell_row", "own", F.col("above").alias("width"))), F.transform(gap, lambda r: F.struct(r.alias("cell_row"), F.lit(0.0).alias("own"), F.col("below").alias("width"))))).alias("c"),
    ).select(entity, "cell_col", "c.*")
    tall = project_y(lat + half) - project_y(lat - half)
    cells = cells.withColumn("intersection_area_m2", F.col("own") + F.col("width") * tall)
    cells = cells.filter(F.col("intersection_area_m2") > tall * F.lit(A * K0 * math.radians(resolution) * SLIVER))
    turn = F.col("_sign") * F.signum("_s.c")
    total = parts.groupBy(entity).agg(F.sum(turn * F.col("_s.c") / 2.0).alias("entity_area_m2"))
    named = cells.withColumns(cell_columns("cell_row", "cell_col", resolution)).join(total, entity)
    return named.select(entity, "cell_id", "lat", "lon", "intersection_area_m2", "entity_area_m2", ratio("intersection_area_m2", "entity_area_m2").alias("weight"))


def cell_window(
    cells: DataFrame,
    *,
    origin_lon: float,
    origin_lat: float,
    resolution: float,
    bounds: Column,
    n_rows: int,
    n_cols: int,
) -> DataFrame:
    """Raster cells (row from the north, column from the west) that a bounding box touches."""
    row0 = F.greatest(F.lit(0), F.floor((F.lit(origin_lat) - bounds["max_lat"]) / resolution))
    row1 = F.least(F.lit(n_rows), F.ceil((F.lit(origin_lat) - bounds["min_lat"]) / resolution))
    col0 = F.greatest(F.lit(0), F.floor((bounds["min_lon"] - origin_lon) / resolution))
    col1 = F.least(F.lit(n_cols), F.ceil((bounds["max_lon"] - origin_lon) / resolution))
    return cells.filter(
        (F.col("cell_row") >= row0)
        & (F.col("cell_row") < row1)
        & (F.col("cell_col") >= col0)
        & (F.col("cell_col") < col1)
    )


def grid_fingerprints(cells: DataFrame, *, day: str, cell: str) -> DataFrame:
    """Cell count and order-free digest of the grid in use on each day."""
    return cells.groupBy(day).agg(
        F.count(F.lit(1)).alias("n_cells"), F.sum(digest_int(cell)).alias("fingerprint")
    )


def build_reference(
    boundaries: DataFrame,
    population: DataFrame,
    groups: DataFrame,
    *,
    entity: str = "entity_id",
    group_key: str,
) -> DataFrame:
    """Boundary attributes with population, group name and population density."""
    return (
        boundaries.join(population, entity, "left")
        .join(groups, group_key, "left")
        .drop(group_key)
        .withColumn(
            "population_density_per_km2", ratio("population_reference", "area_km2")
        )
    )
