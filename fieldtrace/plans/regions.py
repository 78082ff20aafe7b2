"""A layer of regions with a special site cut in, and its labels and weights on points."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldtrace.functions.codes import map_country
from fieldtrace.operators.joins import union_all
from fieldtrace.operators.keyed import ROWS, attach_per_key
from fieldtrace.operators.spatial import covering_polygons


def region_layer(countries: DataFrame, site: DataFrame, continent: str, site_name: str) -> DataFrame:
    """Edges (x1, y1, x2, y2) of the regions of one continent, by name, and of a site that is a region of its own.

    ``countries`` has name, continent and edges, ``site`` edges.  ``priority`` says which region a position in several
    is of: the site (0) before the country around it (1), as if it were cut out.
    """
    side = ("x1", "y1", "x2", "y2")
    kept = countries.where(F.col("continent") == continent).select(map_country("name").alias("region"), F.lit(1).alias("priority"), *side)
    return union_all(kept, site.select(F.lit(site_name).alias("region"), F.lit(0).alias("priority"), *side)).withColumn(
        "layer", F.concat_ws("|", "priority", "region"))


def label_regions(points: DataFrame, layer: DataFrame, weights: DataFrame, weight: str, x: str = "lon", y: str = "lat", cell: float = 1.0) -> DataFrame:
    """The points with the region that holds them and its weight, by priority, then name.

    A position in no region, or in one without a weight, has the weight 1; a region without a weight is not named.
    Each distinct position is looked up once.
    """
    names = layer.select("layer", "region", "priority").distinct()
    held = covering_polygons(points, layer, "layer", x, y, cell).join(F.broadcast(names), "layer")  # one row per region
    first = held.groupBy(x, y).agg(F.min(F.struct("priority", "region")).alias("_r")).select(x, y, F.col("_r.region").alias("region"))
    found = first.join(weights.select("region", F.col(weight).alias("_w")), "region")
    sized = points.groupBy(x, y).agg(F.count(F.lit(1)).alias(ROWS)).join(found, [x, y])
    return attach_per_key(points, sized, [x, y], "left").select(*points.columns, "region", F.coalesce("_w", F.lit(1.0)).alias(weight))
