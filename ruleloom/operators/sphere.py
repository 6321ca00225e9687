"""Nearest places on a sphere: an equi-join on cells whose width in degrees grows towards the poles."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EARTH_M = 6_371_008.8
#: Degrees of a cell at least, so that counts of cells stay whole numbers of modest size.
LEAST_DEGREES = 1e-5
#: Finer grids below a radius, each of half the width.
FINER = 9


def haversine_m(lat1: Column, lng1: Column, lat2: Column, lng2: Column) -> Column:
    """Metres between two points in degrees."""
    half = lambda a, b: F.pow(F.sin(F.radians(a - b) / 2), F.lit(2.0))
    x = half(lat2, lat1) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * half(lng2, lng1)
    return 2 * EARTH_M * F.asin(F.least(F.lit(1.0), F.sqrt(x)))


def _bands(radius_m: float) -> tuple[float, int]:
    """Degrees of a band of latitude, no less than the radius, and how many there are."""
    step = max(math.degrees(radius_m / EARTH_M) * 1.001, LEAST_DEGREES)
    return step, max(1, math.ceil(180 / step))


def _around(band: Column, step: Column) -> Column:
    """Cells of a band: as many as leave each at least the radius wide, also one band nearer the pole."""
    far = F.greatest(F.abs((band - 1) * step - 90), F.abs((band + 2) * step - 90))
    return F.when(far >= 89.9, F.lit(1)).otherwise(F.greatest(F.lit(1), F.floor(360 * F.cos(F.radians(far)) / step))).cast("long")


def _cell(lng: Column, n: Column) -> Column:
    return F.pmod(F.floor((lng + 180) / 360 * n), n).cast("long")


def _nearest(points: DataFrame, sites: DataFrame, radii: list[float], whole: bool) -> DataFrame:
    """``(id, site, metres)`` by grids of rising radii; of a point that has no site within the last the row may be missing or farther, if the last isn't ``whole``, the sphere.

    One site of each of the cells a point lies in bounds how far its nearest can be, and the point looks about in the first grid
    that reaches so far: where sites lie close, few share a cell. Both sides are many times what Spark takes them for by their
    files, and sent whole through the driver if it may, so the joins are merges.
    """
    grids = F.array(*[F.struct(F.lit(i).alias("_grid"), F.lit(step).alias("_step"), F.lit(count).cast("long").alias("_count")) for i, (step, count) in enumerate(map(_bands, radii))])
    band = lambda lat: F.least(F.floor((lat + 90) / F.col("_step")), F.col("_count") - 1).cast("long")
    placed = lambda df, lat, lng: df.withColumn("_band", band(F.col(lat))).withColumn("_cell", _cell(F.col(lng), _around(F.col("_band"), F.col("_step"))))
    key = ["_grid", "_band", "_cell"]
    there = sites.where("lat IS NOT NULL AND lng IS NOT NULL").groupBy(F.col("lat").alias("_lat"), F.col("lng").alias("_lng")).agg(F.min("site").alias("site"))
    any_ = there.agg(F.min(F.struct("_lat", "_lng")).alias("_any"))
    # a cell's sites are one row and their least is found in it: pairs as rows would be sorted by point
    there = placed(there.select("*", F.inline(grids)), "_lat", "_lng").groupBy(*key).agg(F.collect_list(F.struct("_lat", "_lng", "site")).alias("_sites"))
    metres = lambda s: haversine_m(F.col("lat"), F.col("lng"), s["_lat"], s["_lng"])
    here = points.where("lat IS NOT NULL AND lng IS NOT NULL").select("id", "lat", "lng")
    if len(radii) > 1:
        # the sphere itself is one cell, and one site bounds all points in it
        own = placed(here.select("*", F.inline(F.slice(grids, 1, len(radii) - 1) if whole else grids)), "lat", "lng")
        bound = own.join(there.select(*key, F.get("_sites", F.lit(0)).alias("_one")).hint("merge"), key).groupBy("id").agg(F.min(metres(F.col("_one"))).alias("_bound"))
        here = here.join(bound.hint("merge"), "id", "left")
        here = here.join(F.broadcast(any_)).withColumn("_bound", F.least("_bound", metres(F.col("_any")))) if whole else here
        reach = F.size(F.filter(F.array(*map(F.lit, radii)), lambda r: r < F.col("_bound")))
        here = here.withColumn("_at", F.when(F.col("_bound").isNull(), len(radii) - 1).otherwise(F.least(reach, F.lit(len(radii) - 1))))
    else:
        here = here.withColumn("_at", F.lit(0))
    here = here.select("id", "lat", "lng", F.inline(F.array(F.get(grids, F.col("_at")))))
    here = here.withColumn("_band", F.explode(F.transform(F.array(F.lit(-1), F.lit(0), F.lit(1)), lambda d: band(F.col("lat")) + d))).where("_band BETWEEN 0 AND _count - 1").withColumn("_n", _around(F.col("_band"), F.col("_step")))
    cells = F.array_distinct(F.transform(F.array(F.lit(-1), F.lit(0), F.lit(1)), lambda d: F.pmod(_cell(F.col("lng"), F.col("_n")) + d, F.col("_n"))))
    here = here.withColumn("_cell", F.explode(cells)).select("id", "lat", "lng", *key)
    least = F.array_min(F.transform("_sites", lambda s: F.struct(metres(s).alias("metres"), s["site"].alias("site"))))
    # generated, so that a point's rows are sorted by their least alone, without the sites
    met = here.join(there.hint("merge"), key).select("id", F.inline(F.array(least)))
    best = met.groupBy("id").agg(F.min(F.struct("metres", "site")).alias("x"))
    return best.select("id", F.col("x.site").alias("site"), F.col("x.metres").alias("metres"))


def nearest_within(points: DataFrame, sites: DataFrame, radius_m: float) -> DataFrame:
    """``(id, site, metres)`` of points with a site within the radius: the nearest, of equal ones the least id.

    ``points(id, lat, lng)``, ``sites(site, lat, lng)`` in degrees; nulls take no part. A point looks into its own
    and the two next bands, and there into the cell of its longitude and its
    neighbours, around the antimeridian too.  Sites at one place are one, the least. There are grids of the
    radius, half of it, and so on (:func:`_nearest`).
    """
    return _nearest(points, sites, _finer(radius_m), whole=False).where(F.col("metres") <= radius_m)


def _finer(radius_m: float) -> list[float]:
    return [radius_m / 2**k for k in range(FINER, -1, -1)]


def nearest(points: DataFrame, sites: DataFrame, radius_m: float, growth: float = 2.0) -> DataFrame:
    """The same for every point, however far: grids grow on by ``growth`` until they go around the sphere.

    The number of grids depends on the radius alone; without any site there is no row.
    """
    radii = _finer(radius_m)
    while radii[-1] < math.pi * EARTH_M:
        radii.append(radii[-1] * growth)
    return _nearest(points, sites, radii, whole=True)
