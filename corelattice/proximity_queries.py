"""Queries of problem 1: cells near cells, and cells inside cores."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corelattice.operators.current import current_rows
from corelattice.operators.proximity import disc_of_polygon, in_micrometres, inside_discs, inside_polygons, near_pairs, vertices
from corelattice.plans.lineage import written
from corelattice.sources.tables import table

NEAR_UM = 3.0


def _cells(spark: SparkSession, sf: str) -> DataFrame:
    cells = current_rows(table(spark, sf, "adata_obs"), ["image", "tma_label", "x_coordinate", "y_coordinate", "coord_system"])
    cells = in_micrometres(cells, table(spark, sf, "tma_images"), ["x_coordinate", "y_coordinate"])
    cells = cells.withColumn("loose", F.coalesce(F.trim("tma_label") == "", F.lit(True)))
    # read three times below: written once, so that keys are made current once
    return written(cells.select("cell_key", "image", "x_coordinate", "y_coordinate", "loose"), "cells")


def _cores(spark: SparkSession, sf: str) -> DataFrame:
    cores = table(spark, sf, "cores_gdf").select("core_id", "image", "x", "y", "radius", "coord_system", "circles").dropDuplicates(["core_id"])
    return in_micrometres(disc_of_polygon(cores, "circles", "x", "y", "radius"), table(spark, sf, "tma_images"), ["x", "y", "radius"])


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    """Pairs of cells within 3 micrometres, and unlabelled cells inside cores."""
    cells = _cells(spark, sf)
    near = near_pairs(cells, "image", "cell_key", "x_coordinate", "y_coordinate", NEAR_UM)
    loose = cells.where("loose")
    inside = inside_discs(loose, _cores(spark, sf), "image", "cell_key", "x_coordinate", "y_coordinate", "core_id", "x", "y", "radius")
    return near.select(F.lit("near").alias("kind"), "key_a", "key_b").unionByName(inside.select(F.lit("inside").alias("kind"), "key_a", "key_b"))


def inside_outlines(spark: SparkSession, sf: str) -> DataFrame:
    """Cells inside the drawn outlines of cores, as polygons."""
    cores = table(spark, sf, "cores_gdf").where("circles is not null").select("core_id", "image", "coord_system", vertices("circles").alias("ring")).dropDuplicates(["core_id"])
    # one unit for all: the vertices one by one
    scale = table(spark, sf, "tma_images").select("image", "mpp").dropDuplicates(["image"])
    cores = cores.join(scale, "image").withColumn("k", F.when(F.col("coord_system") == "um", 1.0).otherwise(F.col("mpp")))
    cores = cores.withColumn("ring", F.transform("ring", lambda v: F.struct((v["x"] * F.col("k")).alias("x"), (v["y"] * F.col("k")).alias("y"))))
    return inside_polygons(_cells(spark, sf), cores, "image", "cell_key", "x_coordinate", "y_coordinate", "core_id", "ring").select("image", "key_a", "key_b")


QUERIES = {"p1_found": p1_found, "inside_outlines": inside_outlines}

_CELLS_SQL = """
cells AS (
  SELECT cell_key, o.image, tma_label,
         x_coordinate * CASE coord_system WHEN 'um' THEN 1 ELSE mpp END AS x,
         y_coordinate * CASE coord_system WHEN 'um' THEN 1 ELSE mpp END AS y
  FROM (SELECT * FROM adata_obs QUALIFY row_number() OVER (PARTITION BY cell_key ORDER BY loaded_at DESC) = 1) o
  LEFT JOIN tma_images i ON o.image = i.image)
"""

ORACLE = {
    "p1_found": f"""
WITH {_CELLS_SQL},
c0 AS (SELECT DISTINCT core_id, image, x, y, radius, coord_system, circles FROM cores_gdf),
v AS (SELECT core_id, unnest(list_transform(regexp_extract_all(circles, '-?[0-9.]+'), lambda s: s::DOUBLE)) AS n,
             generate_subscripts(regexp_extract_all(circles, '-?[0-9.]+'), 1) AS i FROM c0 WHERE radius IS NULL OR isnan(radius)),
r AS (SELECT a.core_id, avg(sqrt((a.n - c0.x) ** 2 + (b.n - c0.y) ** 2)) AS rr
      FROM v a JOIN v b ON a.core_id = b.core_id AND a.i % 2 = 1 AND b.i = a.i + 1 JOIN c0 ON c0.core_id = a.core_id GROUP BY 1),
cores AS (SELECT c0.core_id, c0.image, c0.x * k AS x, c0.y * k AS y, coalesce(CASE WHEN isnan(radius) THEN NULL ELSE radius END, rr) * k AS radius
          FROM (SELECT c0.*, CASE coord_system WHEN 'um' THEN 1 ELSE mpp END AS k FROM c0 JOIN tma_images i ON i.image = c0.image) c0
          LEFT JOIN r ON r.core_id = c0.core_id)
SELECT 'near' AS kind, a.cell_key AS key_a, b.cell_key AS key_b
FROM cells a JOIN cells b ON a.image = b.image AND a.cell_key < b.cell_key
WHERE (a.x - b.x) ** 2 + (a.y - b.y) ** 2 <= 9.0
UNION ALL
SELECT 'inside', a.cell_key, c.core_id FROM cells a JOIN cores c ON a.image = c.image
WHERE (a.tma_label IS NULL OR trim(a.tma_label) = '') AND (a.x - c.x) ** 2 + (a.y - c.y) ** 2 <= c.radius ** 2
""",
    "inside_outlines": f"""
WITH {_CELLS_SQL},
c0 AS (SELECT DISTINCT core_id, c.image, circles, CASE coord_system WHEN 'um' THEN 1 ELSE mpp END AS k FROM cores_gdf c JOIN tma_images i ON i.image = c.image WHERE circles IS NOT NULL),
n AS (SELECT core_id, image, k, list_transform(regexp_extract_all(circles, '-?[0-9]+\\.?[0-9]*(?:[eE][-+]?[0-9]+)?'), lambda s: s::DOUBLE) AS n FROM c0),
e AS (SELECT core_id, image, n[2 * i - 1] * k AS ax, n[2 * i] * k AS ay, n[2 * i + 1] * k AS bx, n[2 * i + 2] * k AS bb FROM (SELECT *, unnest(range(1, (len(n) // 2)::BIGINT)) AS i FROM n)),
b AS (SELECT core_id, image, min(ax) AS x0, max(ax) AS x1, min(ay) AS y0, max(ay) AS y1 FROM e GROUP BY ALL),
m AS (SELECT p.image, cell_key, core_id, x, y FROM cells p JOIN b ON b.image = p.image AND x BETWEEN x0 AND x1 AND y BETWEEN y0 AND y1)
SELECT image, cell_key AS key_a, core_id AS key_b FROM m JOIN e USING (image, core_id) WHERE (ay > y) <> (bb > y) AND x < (bx - ax) * (y - ay) / (bb - ay) + ax
GROUP BY ALL HAVING count(*) % 2 = 1
""",
}
