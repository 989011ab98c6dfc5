"""Grids on the sphere, nearest neighbours and inverse-distance interpolation."""

from __future__ import annotations

from math import pi

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skillcube.functions import columns as C

#: Levels of the cubes that points are put in: edges of 4 (all of the sphere and more) down to a half kilometre.
COARSEST, FINEST, STEP = -2, 13, 3
#: Source points that every far target may be compared with.
FEW_POINTS = 4_096
#: Ring and longitude offset of the twelve base pixels of the HEALPix scheme (fixed values).
RING, OFFSET = (2, 2, 2, 2, 3, 3, 3, 3, 4, 4, 4, 4), (1, 3, 5, 7, 0, 2, 4, 6, 1, 3, 5, 7)


def lonlat_grid(spark: SparkSession, resolution: float = 5.625) -> DataFrame:
    """cell_id, lat_idx, lon_idx, lat, lon of the cell centres of an equiangular grid."""
    nlon, nlat = round(360 / resolution), round(180 / resolution)
    at = spark.range(nlon * nlat).select(F.col("id").cast("int").alias("cell_id"), F.floor(F.col("id") / nlon).cast("int").alias("lat_idx"), (F.col("id") % nlon).cast("int").alias("lon_idx"))
    return at.withColumn("lat", F.lit(-90.0 + resolution / 2) + F.col("lat_idx") * resolution).withColumn("lon", F.col("lon_idx") * resolution)


def _even_bits(x: Column, bits: int) -> Column:
    return sum((F.shiftleft(F.shiftright(x, 2 * b).bitwiseAND(F.lit(1).cast("long")), b) for b in range(bits)), F.lit(0).cast("long"))


def healpix(spark: SparkSession, nside: int) -> DataFrame:
    """pix, lon, lat of the HEALPix pixel centres in nested order (Gorski et al. 2005)."""
    if nside < 1 or nside & (nside - 1):
        raise ValueError(f"nside must be a power of two, got {nside}")
    order, pix = nside.bit_length() - 1, F.col("pix")
    face = F.floor(pix / (nside * nside)).cast("int")
    inside = pix % (nside * nside)
    p = spark.range(12 * nside * nside).withColumnRenamed("id", "pix").select("pix", face.alias("face"), _even_bits(inside, order).alias("x"), _even_bits(F.shiftright(inside, 1), order).alias("y"))
    ring, off = (F.element_at(F.array(*map(F.lit, t)), F.col("face") + 1) for t in (RING, OFFSET))
    p = p.withColumn("ring", ring * nside - F.col("x") - F.col("y") - 1).withColumn("off", off)
    i = F.col("ring")
    north, south = i < nside, i > 3 * nside
    per = F.when(north, i).when(south, 4 * nside - i).otherwise(nside)
    cap = 1 - F.pow(per, 2) / (3.0 * nside * nside)
    z = F.when(north, cap).when(south, -cap).otherwise((2 * nside - i) * (2.0 / (3.0 * nside)))
    shift = F.when(north | south, 0).otherwise((i - nside) % 2)
    # position along the ring from 1: (offset * per + x - y + 1 + shift) / 2, wrapped
    j = (F.col("off") * per + F.col("x") - F.col("y") + 1 + shift) / 2
    j = F.when(j > 4 * per, j - 4 * per).when(j < 1, j + 4 * per).otherwise(j)
    phi = (j - (shift + 1) * 0.5) * (pi / 2) / per
    return p.select("pix", F.degrees(phi).alias("lon"), (90.0 - F.degrees(F.acos(z))).alias("lat"))


def coarser(pix: Column, factor: int) -> Column:
    """The nested pixel that holds `pix` on a mesh with `factor` times fewer pixels."""
    return F.floor(pix / factor).cast("long")


def _cubes(points: DataFrame, level: Column) -> DataFrame:
    """Adds ix, iy, iz: the cube of edge 2 ** -level that holds the point's unit vector."""
    v = C.unit_vector(F.col("lat"), F.col("lon"))
    scale = F.pow(F.lit(2.0), level)
    return points.withColumns({f"i{x}": F.floor(v[x] * scale).cast("int") for x in "xyz"})


def knn(source: DataFrame, to: DataFrame, k: int, few: bool | None = None) -> DataFrame:
    """to_id, from_id, rank (from 1), dist (radians): the k nearest points of `source` for each of `to`.

    Both have id, lon, lat; ties go to the smaller id. Points lie in cubes of halving edges around their unit
    vectors. Where a target's own cube holds k source points, all of its nearest lie within that cube's
    diagonal, so in the cubes of twice the edge around it: the finest such level is searched, by equality of cubes. A
    target without such a cube is far from the source points, or these are few. Few of them (FEW_POINTS; few: whether that is
    known, else they are counted) are all looked at; many are searched from the whole sphere down (`_from_above`). Of source points at
    one place only k can be among the nearest; the others are left aside first.
    """
    levels = range(COARSEST, FINEST + 1)
    cube = ["level", "ix", "iy", "iz"]

    def at(points: DataFrame, of) -> DataFrame:
        rows = points.withColumn("level", F.explode(F.array(*map(F.lit, of))))
        return _cubes(rows, F.col("level"))

    place = Window.partitionBy("lon", "lat").orderBy("id")
    source = source.select("id", "lon", "lat").withColumn("_k", F.row_number().over(place)).where(F.col("_k") <= k).drop("_k")
    many = at(source.select("lon", "lat"), levels[2:]).groupBy(*cube).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= k)
    targets = to.select(F.col("id").alias("to_id"), "lon", "lat")
    fine = at(targets, levels[2:]).join(many, cube).groupBy("to_id").agg((F.max("level") - 1).alias("level"))
    levelled = targets.join(fine, "to_id", "left")
    few = source.limit(FEW_POINTS + 1).count() <= FEW_POINTS if few is None else few
    near = levelled.withColumn("level", F.coalesce("level", F.lit(COARSEST))) if few else levelled.where("level is not null")
    asked = _cubes(near, F.col("level"))
    for x in "xyz":
        asked = asked.withColumn(f"i{x}", F.explode(F.array(*[F.col(f"i{x}") + d for d in (-1, 0, 1)])))
    held = at(source.select(F.col("id").alias("from_id"), "lon", "lat"), levels).select(*cube, "from_id", F.col("lon").alias("flon"), F.col("lat").alias("flat"))
    pairs = asked.join(held, cube).select("to_id", "lon", "lat", "from_id", "flon", "flat")
    if not few:
        pairs = pairs.unionByName(_from_above(source, levelled.where("level is null").drop("level"), k))
    d = pairs.withColumn("dist", C.haversine(F.col("flat"), F.col("flon"), F.col("lat"), F.col("lon")))
    near = d.withColumn("rank", F.row_number().over(Window.partitionBy("to_id").orderBy("dist", "from_id")))
    return near.where(F.col("rank") <= k).select("to_id", "from_id", "rank", "dist")


def _from_above(source: DataFrame, targets: DataFrame, k: int) -> DataFrame:
    """to_id, lon, lat, from_id, flon, flat: pairs that hold the k nearest of each target, however far they are.

    A target keeps the cubes that may hold one of its k nearest: those no farther at their nearest than the cubes that surely hold k
    are at their farthest. From level to level these give way to their parts, and the last ones to their points. So a target keeps about as many
    cubes as the sphere around it with its k nearest cuts, whatever the number of source points.
    """
    parts = ["ix", "iy", "iz"]

    def counts(level: int) -> DataFrame:
        return _cubes(source.select("lon", "lat"), F.lit(level)).groupBy(*parts).agg(F.count(F.lit(1)).alias("n"))

    def kept(rows: DataFrame, level: int) -> DataFrame:
        edge = 2.0**-level
        low = {x: F.col(f"i{x}") * F.lit(edge) for x in "xyz"}
        inner = sum((F.pow(F.greatest(low[x] - F.col(f"_v.{x}"), F.col(f"_v.{x}") - low[x] - edge, F.lit(0.0)), 2) for x in "xyz"), F.lit(0.0))
        outer = sum((F.pow(F.greatest(F.abs(F.col(f"_v.{x}") - low[x]), F.abs(F.col(f"_v.{x}") - low[x] - edge)), 2) for x in "xyz"), F.lit(0.0))
        rows = rows.withColumn("_in", inner).withColumn("_out", outer)
        sure = F.sum("n").over(Window.partitionBy("to_id").orderBy("_out", *parts).rowsBetween(Window.unboundedPreceding, 0))
        bar = F.min(F.when(F.col("_sure") >= k, F.col("_out"))).over(Window.partitionBy("to_id"))
        return rows.withColumn("_sure", sure).withColumn("_bar", bar).where(F.col("_bar").isNull() | (F.col("_in") <= F.col("_bar") + 1e-12)).select("to_id", "lon", "lat", "_v", *parts)

    asked = targets.withColumn("_v", C.unit_vector(F.col("lat"), F.col("lon")))
    front = kept(asked.join(F.broadcast(counts(COARSEST))), COARSEST)  # eight cubes hold the sphere
    for level in range(COARSEST + STEP, FINEST + 1, STEP):
        finer = counts(level)
        for x in parts:
            finer = finer.withColumn(f"_{x}", F.floor(F.col(x) / 2**STEP).cast("int"))
        front = front.withColumnsRenamed({x: f"_{x}" for x in parts}).join(finer, [f"_{x}" for x in parts]).drop(*[f"_{x}" for x in parts])
        front = kept(front, level)
    last = range(COARSEST, FINEST + 1, STEP)[-1]
    points = _cubes(source.select(F.col("id").alias("from_id"), "lon", "lat"), F.lit(last)).withColumnsRenamed({"lon": "flon", "lat": "flat"})
    return front.join(points, parts).select("to_id", "lon", "lat", "from_id", "flon", "flat")


def interpolate(edges: DataFrame, values: DataFrame, power: float = 2.0, eps: float = 1e-12, by=()) -> DataFrame:
    """id, value by inverse distance: weights 1 / (dist ** power + eps), normalized."""
    w = 1 / (F.pow("dist", F.lit(power)) + eps)
    rows = edges.join(values.withColumnRenamed("id", "from_id"), "from_id").withColumn("w", w)
    return rows.groupBy(F.col("to_id").alias("id"), *by).agg((F.sum(F.col("w") * F.col("value")) / F.sum("w")).alias("value"))


def round_trip(points: DataFrame, mesh: DataFrame, values: DataFrame, k: int = 8, power: float = 2.0, by=(), few: bool | None = True) -> DataFrame:
    """Values taken from the points to the mesh and back; few: as in knn (both lie all over the sphere as a rule, so nothing is far unless they are few)."""
    there, back = knn(points, mesh, k, few), knn(mesh, points, k, few)
    return interpolate(back, interpolate(there, values, power, by=by), power, by=by)


def weighted_rmse(rows: DataFrame, by=()) -> DataFrame:
    """rmse of columns f and o over (lat, lon), each latitude weighted by its cosine; None: filter rows for a box."""
    w = C.lat_weight(F.col("lat"))
    return rows.groupBy(*by).agg(F.sqrt(F.sum(w * F.pow(F.col("f") - F.col("o"), 2)) / F.sum(w)).alias("rmse"))


def waves(points: DataFrame, seed: int = 0) -> DataFrame:
    """id, name, value: two planetary waves (3 and 6 around a circle of latitude) and white noise."""
    lam, phi = F.radians("lon"), F.radians("lat")
    fields = {"wave_k3": F.cos(3 * lam) * F.cos(phi), "wave_k6": F.cos(6 * lam) * F.cos(phi), "noise": C.gaussian(F.lit(seed), F.col("id"))}
    each = F.explode(F.array(*[F.struct(F.lit(n).alias("name"), e.alias("value")) for n, e in fields.items()])).alias("f")
    return points.select("id", each).select("id", "f.name", "f.value")


def loss_by_resolution(points: DataFrame, spark: SparkSession, nsides=(16, 32), k: int = 8, box=None) -> DataFrame:
    """nside, name, rmse, relative: round-trip RMSE of the waves, and over their range; over all points or those in a box."""
    out, field = None, waves(points)
    span = field.groupBy("name").agg((F.max("value") - F.min("value")).alias("span"))
    for nside in nsides:
        mesh = healpix(spark, nside).withColumnRenamed("pix", "id")
        got = round_trip(points, mesh, field, k, by=("name",)).withColumnRenamed("value", "f")
        rows = got.join(field.withColumnRenamed("value", "o"), ["id", "name"]).join(points.select("id", "lat", "lon"), "id")
        if box is not None:
            rows = rows.where(C.in_box(F.col("lat"), F.col("lon"), box))
        part = weighted_rmse(rows, ("name",)).join(span, "name").select(F.lit(nside).alias("nside"), "name", "rmse", (F.col("rmse") / F.col("span")).alias("relative"))
        out = part if out is None else out.unionByName(part)
    return out


def points_of(spark: SparkSession, cube: DataFrame | None, resolution: float = 5.625) -> DataFrame:
    """id, lon, lat: the cube's own cells, or without a cube those of an equiangular grid."""
    cells = lonlat_grid(spark, resolution) if cube is None else cube.select("cell_id", "lon", "lat").distinct()
    return cells.select(F.col("cell_id").alias("id"), "lon", "lat")
