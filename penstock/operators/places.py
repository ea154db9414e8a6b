"""Greedy circles on the sphere, settled by rounds over tiles of space."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geo import EARTH_M, haversine
from .graph import cut_lineage

#: Distinct positions of a tile, beyond which space is cut finer.
TILE_SPOTS = 4_000
#: Rows of a group that is scanned as it is, without tiles.
GROUP_ROWS = 256
AXES = ("x", "y", "z")
UNDECIDED, SEED, COVERED = 0, 1, 2


def _around(cubes: DataFrame) -> DataFrame:
    """cubes, repeated for the 27 cubes around each."""
    for k in AXES:
        cubes = cubes.withColumn(k, F.explode(F.array(F.col(k) - 1, F.col(k), F.col(k) + 1)))
    return cubes


def _tiles(spots: DataFrame, radius_m: float, most: int) -> DataFrame:
    """(g, x, y, z, tile): the coarsest tile of 4**l cubes a side around each cube that holds no more than `most` spots; a fuller cube is a tile by itself."""
    top = math.ceil(math.log(2 * EARTH_M / radius_m + 2, 4))
    cubes = cut_lineage(spots.groupBy("g", *AXES).agg(F.count("*").alias("n")))
    each = cubes.withColumn("l", F.explode(F.sequence(F.lit(0), F.lit(top))))
    tile = F.concat_ws("|", "l", *[F.call_function("shiftright", F.col(k), (2 * F.col("l")).cast("int")) for k in AXES], "g")
    each = each.withColumn("tile", tile)
    fit = each.groupBy("tile").agg(F.sum("n").alias("total")).where(F.col("total") <= most)
    whole = each.join(fit, "tile").groupBy("g", *AXES).agg(F.max_by("tile", "l").alias("tile"))
    return cut_lineage(cubes.select("g", *AXES).join(whole, ["g", *AXES], "left").withColumn("tile", F.coalesce("tile", F.concat_ws("|", F.lit(0), *AXES, "g"))))


def _within(lat: Column, lng: Column, other: Column, radius_m: float) -> Column:
    return haversine(lat, lng, other["lat"], other["lng"]) <= radius_m


def _by_minima(state: DataFrame, radius_m: float, most: int) -> DataFrame:
    """Settles spots until no cube holds more than `most` undecided ones, by aggregation: a cube's first undecided spot is a seed if no cube around has an earlier one."""
    cube = ["g", *AXES]
    while True:
        first = cut_lineage(state.where(F.col("status") == UNDECIDED).groupBy(*cube).agg(F.min(F.struct("id", "lat", "lng")).alias("m"), F.count("*").alias("n")))
        if not first.where(F.col("n") > most).head(1):
            return state
        least = _around(first.select(*cube, "m.id")).groupBy(*cube).agg(F.min("id").alias("least"))
        seeds = first.join(least, cube).where(F.col("m.id") == F.col("least"))
        near = _around(seeds.select(*cube, "m")).groupBy(*cube).agg(F.collect_list("m").alias("seeds"))  # at most one a cube around
        hit = F.exists("seeds", lambda m: _within(F.col("lat"), F.col("lng"), m, radius_m))
        own = F.exists("seeds", lambda m: m["id"] == F.col("id"))
        status = F.when((F.col("status") == UNDECIDED) & own, SEED).when((F.col("status") == UNDECIDED) & hit, COVERED).otherwise(F.col("status"))
        state = cut_lineage(state.join(near, cube, "left").withColumn("status", status).drop("seeds"))


def _settled(frame: pd.DataFrame, radius_m: float) -> pd.DataFrame:
    """One tile's round: its own spots in order of id, with what lies around it. A spot without an earlier undecided one within the radius is a seed."""
    import numpy as np

    frame = frame.sort_values("id", kind="stable")
    lat, lng = np.radians(frame["lat"].to_numpy()), np.radians(frame["lng"].to_numpy())
    own, status = frame["own"].to_numpy(), frame["status"].to_numpy().copy()
    blocked = np.zeros(len(frame), bool)  # an earlier undecided spot lies within the radius

    def near(i: int, a: int):
        h = np.sin((lat[a:] - lat[i]) / 2) ** 2 + np.cos(lat[i]) * np.cos(lat[a:]) * np.sin((lng[a:] - lng[i]) / 2) ** 2
        return np.flatnonzero(2 * EARTH_M * np.arctan2(np.sqrt(h), np.sqrt(1 - h)) <= radius_m) + a

    for i in np.flatnonzero(status == SEED).tolist():
        x = near(i, 0)
        status[x[status[x] == UNDECIDED]] = COVERED
    for i in range(len(frame)):
        if status[i] != UNDECIDED:
            continue
        x = near(i, i + 1)
        if own[i] and not blocked[i]:
            status[i] = SEED
            status[x[status[x] == UNDECIDED]] = COVERED
        else:
            blocked[x] = True
    done = own & (status != UNDECIDED) & (frame["status"].to_numpy() == UNDECIDED)
    return frame.loc[done, ["g", "id"]].assign(now=status[done])


def _scanned(rows: DataFrame, radius_m: float, by: list[str]) -> DataFrame:
    """rows of small groups with `place`: each group is gathered once and scanned in order of id."""
    kind = rows.schema["id"].dataType.simpleString()
    spot = lambda r: F.struct(r["id"].alias("id"), r["lat"].cast("double").alias("lat"), r["lng"].cast("double").alias("lng"))
    rest = [c for c in rows.columns if c not in by]
    groups = rows.repartition(*by).groupBy(*by).agg(F.collect_list(F.struct(*rest)).alias("_rows"))
    spots = F.array_sort(F.transform(F.filter("_rows", lambda r: r["lat"].isNotNull() & r["lng"].isNotNull()), spot))
    near = lambda s, m: _within(s["lat"], s["lng"], m, radius_m)
    none = F.array().cast(f"array<struct<id:{kind},lat:double,lng:double>>")
    seeds = F.aggregate(spots, none, lambda seen, s: F.when(F.exists(seen, lambda m: near(s, m)), seen).otherwise(F.array_append(seen, s)))
    place = lambda r: F.array_min(F.transform(F.filter("_seeds", lambda m: near(r, m)), lambda m: m["id"]))
    placed = F.transform("_rows", lambda r: F.struct(*[r[c].alias(c) for c in rest], F.when(r["lat"].isNotNull() & r["lng"].isNotNull(), place(r)).alias("place")))
    return groups.withColumn("_seeds", seeds).select(*by, F.inline(placed)).select(*rows.columns, "place")


def place_clusters(points: DataFrame, radius_m: float = 100.0, by: list[str] | None = None, tile_spots: int = TILE_SPOTS) -> DataFrame:
    """points: id, lat, lng (and keys). Greedy circles in order of id: a point joins the first seed within the radius, else becomes one. Adds `place`, the seed's id (null without a position).

    Equal positions are one spot. Space is cut into cubes with the radius for a side, so spots within the radius lie in the same cube or in two that touch, at the poles and the date line too. Cubes are dealt into tiles of a bounded number of spots. In each round a tile takes its spots in order, with the seeds and undecided spots of the cubes that touch it, as far as nothing earlier is open outside; the first open spot of all is settled in every round, so the rounds end. Cubes too full for a task are thinned by aggregation before. Seeds lie further apart than the radius, so few of them are near any cube, and every spot looks for its first one among those.

    Groups (by) of GROUP_ROWS rows or less need none of this: each is scanned as it is."""
    by = by or []
    if by:
        full = cut_lineage(points.groupBy(*by).agg(F.count("*").alias("_n")).where(F.col("_n") > GROUP_ROWS).select(*[F.col(c).alias(f"_{c}") for c in by]))
        if not full.head(1):
            return _scanned(points, radius_m, by)
        told = None
        for c in by:
            same = F.col(c).eqNullSafe(F.col(f"_{c}"))
            told = same if told is None else told & same
        small = _scanned(points.join(full, told, "left_anti"), radius_m, by)
        return small.unionByName(_tiled(points.join(full, told, "left_semi"), radius_m, by, tile_spots))
    return _tiled(points, radius_m, by, tile_spots)


def _tiled(points: DataFrame, radius_m: float, by: list[str], tile_spots: int) -> DataFrame:
    """place_clusters for groups of any size."""
    g = F.to_json(F.struct(*by)) if by else F.lit("")
    rows = points.withColumn("_g", g)
    lat, lng = F.radians("lat"), F.radians("lng")
    axes = {"x": F.cos(lat) * F.cos(lng), "y": F.cos(lat) * F.sin(lng), "z": F.sin(lat)}
    spots = rows.where("lat is not null and lng is not null").groupBy(F.col("_g").alias("g"), "lat", "lng").agg(F.min("id").alias("id"))
    spots = cut_lineage(spots.withColumns({k: F.floor(v * (EARTH_M / radius_m)) for k, v in axes.items()}).withColumn("status", F.lit(UNDECIDED)))
    state = _by_minima(spots, radius_m, tile_spots)
    cube = ["g", *AXES]
    tiles = _tiles(state, radius_m, tile_spots)
    # The cubes that a tile must see: those of other tiles that touch one of its own.
    seen = cut_lineage(_around(tiles.withColumnRenamed("tile", "seer")).distinct().join(tiles, cube).where("seer <> tile").select(*cube, F.col("seer").alias("tile")))
    state = cut_lineage(state.join(tiles, cube))
    kind = points.schema["id"].dataType.simpleString()
    while True:
        open_tiles = cut_lineage(state.where(F.col("status") == UNDECIDED).select("tile").distinct())
        if not open_tiles.head(1):
            break
        live = state.where(F.col("status") < COVERED)
        cols = ["tile", "g", "id", "lat", "lng", "status"]
        outside = live.drop("tile").join(seen, cube).select(*cols, F.lit(False).alias("own"))
        met = live.select(*cols, F.lit(True).alias("own")).unionByName(outside).join(open_tiles, "tile", "left_semi")
        decided = met.groupBy("tile").applyInPandas(lambda frame: _settled(frame, radius_m), f"g string, id {kind}, now int")
        state = cut_lineage(state.join(decided, ["g", "id"], "left").withColumn("status", F.coalesce("now", "status")).drop("now"))
    near = _around(state.where(F.col("status") == SEED).select(*cube, F.struct("id", "lat", "lng").alias("m"))).groupBy(*cube).agg(F.collect_list("m").alias("seeds"))
    first = F.array_min(F.transform(F.filter("seeds", lambda m: _within(F.col("lat"), F.col("lng"), m, radius_m)), lambda m: m["id"]))
    placed = state.join(near, cube).select(F.col("g").alias("_g"), F.col("lat").alias("_lat"), F.col("lng").alias("_lng"), first.alias("place"))
    out = rows.join(placed, (rows["_g"] == placed["_g"]) & (rows["lat"] == placed["_lat"]) & (rows["lng"] == placed["_lng"]), "left")
    return out.select(*[points[c] for c in points.columns], "place")
