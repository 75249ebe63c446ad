"""Queries of pixel, label and shape operators, on the cells and cores of the slides.

Cells as pixels: a cell's pixel is its place in whole micrometres, its channels
are its markers.  Cores as labels and discs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corelattice.base import CELLS, cells
from corelattice.operators import image
from corelattice.operators.proximity import disc_of_polygon, in_micrometres
from corelattice.plans.lineage import written
from corelattice.sources import store
from corelattice.sources.tables import table

QUERIES, ORACLE = {}, {}


def query(sql: str | None = None):
    def keep(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            ORACLE[fn.__name__] = sql
        return fn

    return keep


_THREE = ["NUX1", "EPQ2", "STV3"]  # channels that a projection chooses
_PIX = f"""{CELLS}, pts AS (SELECT c.image, cell_key, x, floor(x_coordinate * k)::INTEGER AS px, floor(y_coordinate * k)::INTEGER AS py FROM
(SELECT c.*, CASE coord_system WHEN 'um' THEN 1 ELSE mpp END AS k FROM cells c JOIN tma_images i ON i.image = c.image) c WHERE x_coordinate IS NOT NULL AND y_coordinate IS NOT NULL AND x IS NOT NULL),
pix AS (SELECT image, name AS c, py AS y, px AS x, max(value) AS value FROM (SELECT image, py, px, generate_subscripts(x, 1) - 1 AS pos, unnest(x) AS value FROM pts) JOIN marker_var USING (pos) WHERE value IS NOT NULL GROUP BY ALL)"""


def _pixels(spark: SparkSession, sf: str) -> DataFrame:
    """Every marker's value at every pixel that holds a cell, the greatest if it holds several."""
    own = in_micrometres(cells(spark, sf, "image", "x_coordinate", "y_coordinate", "coord_system", "x"), table(spark, sf, "tma_images"), ["x_coordinate", "y_coordinate"])
    own = own.where("x is not null and x_coordinate is not null and y_coordinate is not null")
    names = F.broadcast(table(spark, sf, "marker_var").select("pos", F.col("name").alias("c")).dropDuplicates(["pos"]))  # a row for each marker
    flat = own.select("image", F.floor("y_coordinate").cast("int").alias("py"), F.floor("x_coordinate").cast("int").alias("px"), F.posexplode("x").alias("pos", "value"))
    flat = flat.where("value is not null and not isnan(value)").join(names, "pos").select("image", "c", F.col("py").alias("y"), F.col("px").alias("x"), "value")
    return flat.groupBy("image", "c", "y", "x").agg(F.max("value").alias("value"))


_CORES = """c0 AS (SELECT DISTINCT core_id, c.image, tma_label, x, y, CASE WHEN NOT isnan(radius) THEN radius END AS radius, circles, CASE coord_system WHEN 'um' THEN 1 ELSE mpp END AS k FROM cores_gdf c JOIN tma_images i ON i.image = c.image),
ring AS (SELECT core_id, x, y, list_transform(regexp_extract_all(circles, '-?[0-9]+[.]?[0-9]*(?:[eE][-+]?[0-9]+)?'), lambda s: s::DOUBLE) AS n FROM c0 WHERE radius IS NULL),
drawn AS (SELECT core_id, avg(sqrt((n[2 * i - 1] - x) ** 2 + (n[2 * i] - y) ** 2)) AS r FROM (SELECT *, unnest(range(1, (len(n) // 2)::BIGINT)) AS i FROM ring) GROUP BY 1),
cores AS (SELECT core_id, image, tma_label, x * k AS x, y * k AS y, coalesce(radius, r) * k AS radius FROM c0 LEFT JOIN drawn USING (core_id))"""


def _cores(spark: SparkSession, sf: str) -> DataFrame:
    """Every core in micrometres; a radius that isn't given is that of the drawn outline."""
    cores = table(spark, sf, "cores_gdf").select("core_id", "image", "tma_label", "x", "y", "radius", "coord_system", "circles").dropDuplicates(["core_id"])
    cores = disc_of_polygon(cores, "circles", "x", "y", "radius").drop("circles")
    return in_micrometres(cores, table(spark, sf, "tma_images"), ["x", "y", "radius"])


@query(f"WITH {_PIX} SELECT image, 'max[NUX1_STV3]' AS c, y, x, max(value) AS value FROM pix WHERE c IN ('NUX1', 'STV3') GROUP BY ALL")
def channel_projection(spark: SparkSession, sf: str) -> DataFrame:
    return image.project(_pixels(spark, sf), ["NUX1", "STV3"], "max")


@query(f"WITH {_PIX} SELECT image, 'median[NUX1_EPQ2_STV3]' AS c, y, x, round(median(value), 9) AS value FROM pix WHERE c IN ('NUX1', 'EPQ2', 'STV3') GROUP BY ALL")
def channel_projection_median(spark: SparkSession, sf: str) -> DataFrame:
    return image.project(_pixels(spark, sf), _THREE, "median").withColumn("value", F.round("value", 9))


@query(f"WITH {_PIX} SELECT image, c, y // 4 AS y, x // 4 AS x, round(avg(value), 9) AS value FROM pix GROUP BY ALL")
def pyramid_level(spark: SparkSession, sf: str) -> DataFrame:
    return image.pyramid(_pixels(spark, sf), 4).withColumn("value", F.round("value", 9))


@query(f"WITH {_PIX} SELECT image, c, y, x, round(least(greatest((value - 10) / 90, 0), 100) ** 0.5, 9) AS value FROM pix")
def contrast(spark: SparkSession, sf: str) -> DataFrame:
    return _pixels(spark, sf).withColumn("value", F.round(image.corrected(F.col("value"), 10, 100, 0.5), 9))


@query(f"WITH {_PIX} SELECT image, c, y, x, CASE WHEN x BETWEEN 100 AND 300 AND y BETWEEN 50 AND 200 THEN value ELSE 0 END AS value FROM pix")
def masked_box(spark: SparkSession, sf: str) -> DataFrame:
    return image.zero_outside(_pixels(spark, sf), (100, 50, 300, 200))


@query(f"WITH {_CORES} SELECT core_id, round_even(radius / mpp, 0)::BIGINT AS radius_px FROM cores JOIN tma_images USING (image)")
def um_to_px(spark: SparkSession, sf: str) -> DataFrame:
    out = _cores(spark, sf).join(table(spark, sf, "tma_images").select("image", "mpp"), "image")
    return out.select("core_id", image.um_to_px(F.col("radius"), F.col("mpp")).alias("radius_px"))


@query(f"WITH {_CORES} SELECT core_id, round(0.5 * x - 0.25 * y + 10, 9) AS ax, round(0.25 * x + 0.5 * y - 5, 9) AS ay FROM cores")
def affine_shapes(spark: SparkSession, sf: str) -> DataFrame:
    ax, ay = image.affine(F.col("x"), F.col("y"), [[0.5, -0.25, 10], [0.25, 0.5, -5], [0, 0, 1]])
    return _cores(spark, sf).select("core_id", F.round(ax, 9).alias("ax"), F.round(ay, 9).alias("ay"))


_LABELS = f"""{_PIX}, lab AS (SELECT image, y, x, (1 + (x // 60) + 10 * (y // 60))::BIGINT AS label FROM (SELECT DISTINCT image, y, x FROM pix))"""


def _labels(pixels: DataFrame) -> DataFrame:
    return pixels.select("image", "y", "x").distinct().withColumn("label", (1 + F.floor(F.col("x") / 60) + 10 * F.floor(F.col("y") / 60)).cast("long"))


@query(
    f"""WITH {_LABELS}, s AS (SELECT image, label, count(*) AS area, avg(x) AS centroid_x, avg(y) AS centroid_y, var_pop(x) + 1.0::DOUBLE / 12 AS a, var_pop(y) + 1.0::DOUBLE / 12 AS b, covar_pop(x, y) AS c FROM lab GROUP BY ALL),
e AS (SELECT *, (a + b + sqrt((a - b) ** 2 + 4 * c * c)) / 2 AS l1, greatest((a + b - sqrt((a - b) ** 2 + 4 * c * c)) / 2, 0) AS l2 FROM s),
i AS (SELECT image, label, pix.c AS ch, avg(value) AS intensity FROM lab JOIN pix USING (image, y, x) GROUP BY ALL)
SELECT image, label, area, round(centroid_x, 6) AS centroid_x, round(centroid_y, 6) AS centroid_y, round(sqrt(1 - l2 / l1), 5) AS eccentricity, round(4 * sqrt(l1), 5) AS major_axis, ch AS c, round(intensity, 9) AS intensity FROM e JOIN i USING (image, label)"""
)
def measure_labels(spark: SparkSession, sf: str) -> DataFrame:
    pix = written(_pixels(spark, sf), "pixels")
    out = image.measure(_labels(pix), pix)
    return out.select("image", "label", "area", F.round("centroid_x", 6).alias("centroid_x"), F.round("centroid_y", 6).alias("centroid_y"), F.round("eccentricity", 5).alias("eccentricity"), F.round("major_axis", 5).alias("major_axis"), "c", F.round("intensity", 9).alias("intensity"))


@query(f"WITH {_LABELS} SELECT image, label, (row_number() OVER (PARTITION BY image ORDER BY label))::VARCHAR || '_global' AS cell_id FROM (SELECT DISTINCT image, label FROM lab)")
def cell_ids(spark: SparkSession, sf: str) -> DataFrame:
    return image.cell_ids(_labels(_pixels(spark, sf)).select("image", "label").distinct())


@query(
    f"""WITH {_LABELS}, t AS (SELECT image, x // 240 AS tile, y, x, label FROM lab), g AS (SELECT image, tile, max(label) AS top FROM t GROUP BY ALL), m AS (SELECT image, tile, sum(top) OVER (PARTITION BY image ORDER BY tile) - top AS shift FROM g)
SELECT image, tile, y, x, (label + shift)::BIGINT AS label FROM t JOIN m USING (image, tile)"""
)
def merge_tiles(spark: SparkSession, sf: str) -> DataFrame:
    own = _labels(_pixels(spark, sf)).withColumn("tile", F.floor(F.col("x") / 240).cast("int"))
    return image.merged_tiles(own).select("image", "tile", "y", "x", "label")


@query(f"WITH {_LABELS} SELECT image, label, min(x) - 2 AS xmin, min(y) - 2 AS ymin, max(x) + 2 AS xmax, max(y) + 2 AS ymax FROM lab GROUP BY ALL")
def label_boxes(spark: SparkSession, sf: str) -> DataFrame:
    return image.boxes(_labels(_pixels(spark, sf)), 2)


@query(
    f"""WITH {_LABELS}, g AS (SELECT image, y + dy AS y, x + dx AS x, label, dy * dy + dx * dx AS d FROM lab, (SELECT unnest(range(-2, 3)) AS dy), (SELECT unnest(range(-2, 3)) AS dx) WHERE dy * dy + dx * dx <= 4)
SELECT image, y::INTEGER AS y, x::INTEGER AS x, label FROM g WHERE y >= 0 AND x >= 0 QUALIFY row_number() OVER (PARTITION BY image, y, x ORDER BY d, label) = 1"""
)
def expand_labels(spark: SparkSession, sf: str) -> DataFrame:
    return image.grown(_labels(_pixels(spark, sf)), 2)


@query()
def blurred_masks(spark: SparkSession, sf: str) -> DataFrame:
    return image.masks(image.project(_pixels(spark, sf), _THREE, "max"), 4.0, image.area_threshold(5.0), 1)


@query()
def detect_blobs(spark: SparkSession, sf: str) -> DataFrame:
    return image.blobs(image.pyramid(image.project(_pixels(spark, sf), _THREE, "max"), 4), 5.0, 15.0)


# grids of cores -------------------------------------------------------------


@query(
    f"""WITH {_CORES}, d AS (SELECT *, 1.0::DOUBLE * avg(radius) OVER (PARTITION BY image) AS d FROM cores),
p AS (SELECT a.image, degrees(atan2(b.y - a.y, b.x - a.x)) AS angle FROM d a JOIN d b ON a.image = b.image AND b.x - a.x > 2 * a.d AND abs(b.y - a.y) < a.d)
SELECT image, round(coalesce(median(angle), 0), 8) AS angle FROM (SELECT DISTINCT image FROM d) LEFT JOIN p USING (image) GROUP BY 1"""
)
def rotation(spark: SparkSession, sf: str) -> DataFrame:
    from pyspark.sql import Window

    own = _cores(spark, sf).withColumn("d", F.avg("radius").over(Window.partitionBy("image")))
    return image.rotation(own, "image", "core_id", "x", "y", F.col("d")).withColumn("angle", F.round("angle", 8))


_LINES = """l AS (SELECT image, {v}, coalesce(({v} - lag({v}) OVER w > 45)::INTEGER, 0) AS new FROM cores WINDOW w AS (PARTITION BY image ORDER BY {v})),
k AS (SELECT image, {v}, sum(new) OVER (PARTITION BY image ORDER BY {v} ROWS UNBOUNDED PRECEDING)::BIGINT AS line FROM l)"""


@query(f"WITH {_CORES}, {_LINES.format(v='y')} SELECT image, line, round(avg(y), 8) AS centre, count(*) AS n FROM k GROUP BY ALL")
def grid_sessions(spark: SparkSession, sf: str) -> DataFrame:
    return image.gap_walk(_cores(spark, sf), "image", "y", 45.0).withColumn("centre", F.round("centre", 8))


@query(
    f"""WITH {_CORES}, {_LINES.format(v='y')}, gy AS (SELECT image, line AS row, avg(y) AS gy FROM k GROUP BY ALL),
{_LINES.format(v='x').replace('l AS', 'lx AS').replace('FROM l WINDOW', 'FROM lx WINDOW').replace('k AS', 'kx AS').replace('FROM l)', 'FROM lx)')}, gx AS (SELECT image, line AS col, avg(x) AS gx FROM kx GROUP BY ALL),
g AS (SELECT image, gx, gy, CASE WHEN row >= 26 THEN chr((64 + row // 26)::INTEGER) ELSE '' END || chr((65 + row % 26)::INTEGER) || '-' || (col + 1)::VARCHAR AS label FROM gy JOIN gx USING (image)),
d AS (SELECT image, core_id, x, y, avg(radius) OVER (PARTITION BY image) AS r FROM cores),
m AS (SELECT g.image, label, core_id, sqrt((gx - x) ** 2 + (gy - y) ** 2) AS distance FROM g JOIN d ON d.image = g.image WHERE sqrt((gx - x) ** 2 + (gy - y) ** 2) <= 1.25::DOUBLE * r),
a AS (SELECT * FROM m QUALIFY row_number() OVER (PARTITION BY image, label ORDER BY distance, core_id) = 1),
b AS (SELECT * FROM a QUALIFY row_number() OVER (PARTITION BY image, core_id ORDER BY distance, label) = 1)
SELECT image, label, core_id, round(distance, 8) AS distance FROM g LEFT JOIN b USING (image, label)"""
)
def dearray(spark: SparkSession, sf: str) -> DataFrame:
    own = written(_cores(spark, sf), "cores")
    grid = image.grid_points(image.gap_walk(own, "image", "y", 45.0), image.gap_walk(own, "image", "x", 45.0), "image")
    return image.match_grid(grid, own, "image", "core_id", "x", "y", "radius").withColumn("distance", F.round("distance", 8))


@query(f"WITH {_CORES} SELECT a.image, a.core_id AS a, b.core_id AS b FROM cores a JOIN cores b ON a.image = b.image AND a.core_id < b.core_id WHERE sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) < a.radius + b.radius")
def overlapping_cores(spark: SparkSession, sf: str) -> DataFrame:
    return image.overlapping_discs(_cores(spark, sf), "image", "core_id", "x", "y", "radius", 100.0)


@query(
    f"""WITH {_LABELS}, {_CORES}, m AS (SELECT image, label, min(x) - 1 AS x0, min(y) - 1 AS y0, max(x) + 1 AS x1, max(y) + 1 AS y1 FROM lab GROUP BY ALL)
SELECT c.image, core_id, round(least(c.x - radius, min(x0)), 8) AS xmin, round(least(c.y - radius, min(y0)), 8) AS ymin, round(greatest(c.x + radius, max(x1)), 8) AS xmax, round(greatest(c.y + radius, max(y1)), 8) AS ymax
FROM cores c LEFT JOIN m ON m.image = c.image AND c.x - radius <= x1 AND x0 <= c.x + radius AND c.y - radius <= y1 AND y0 <= c.y + radius GROUP BY c.image, core_id, c.x, c.y, radius"""
)
def envelope(spark: SparkSession, sf: str) -> DataFrame:
    masks = image.boxes(_labels(_pixels(spark, sf)), 1)
    out = image.envelopes(image.disc_boxes(_cores(spark, sf), "x", "y", "radius"), masks, "image", "core_id", "label", 100.0)
    return out.withColumns({c: F.round(c, 8) for c in ("xmin", "ymin", "xmax", "ymax")})


@query(f"WITH {_CORES} SELECT core_id FROM cores WHERE tma_label IS DISTINCT FROM 'A-1'")
def deleted_shapes(spark: SparkSession, sf: str) -> DataFrame:
    own = image.disc_boxes(_cores(spark, sf), "x", "y", "radius")
    return image.deleted(own, own.where("tma_label = 'A-1'"), ["image", "xmin", "ymin", "xmax", "ymax"]).select("core_id")


@query(f"WITH {_CORES} SELECT core_id, round(r, 6) AS radius FROM drawn")
def polygon_radius(spark: SparkSession, sf: str) -> DataFrame:
    """The radius of the drawn outline of every core without a given one."""
    cores = table(spark, sf, "cores_gdf").where("radius is null or isnan(radius)").dropDuplicates(["core_id"])
    return disc_of_polygon(cores, "circles", "x", "y", "radius").select("core_id", F.round("radius", 6).alias("radius"))


# sources --------------------------------------------------------------------


@query("SELECT image, (1 / mpp) AS px_per_um FROM tma_images")
def image_scale(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "tma_images").select("image", (1 / F.col("mpp")).alias("px_per_um"))


@query("SELECT sample_id, label, \"grouping\", event, time FROM (SELECT DISTINCT * FROM sample_meta)")
def metadata_csv(spark: SparkSession, sf: str) -> DataFrame:
    """The sample table by way of a CSV file and back."""
    import uuid

    from corelattice.plans.lineage import shared_folder

    path = f"{shared_folder(spark)}/csv-{uuid.uuid4().hex}"
    table(spark, sf, "sample_meta").distinct().select("sample_id", "label", "grouping", "event", "time").write.option("header", True).csv(path)
    got = store.read_metadata_csv(spark, path)
    return got.select("sample_id", "label", "grouping", F.col("event").cast("boolean").alias("event"), F.col("time").cast("double").alias("time"))


@query("SELECT core_id, image FROM cores_gdf GROUP BY ALL")
def element_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    """Shapes put into a store, replaced by a table computed from themselves, and read."""
    import uuid

    from corelattice.plans.lineage import shared_folder

    s = store.Store(spark, f"{shared_folder(spark)}/store-{uuid.uuid4().hex}")
    name = s.put("cores", table(spark, sf, "cores_gdf").select("core_id", "image"), "shapes")
    s.put(name, s.get(name).distinct(), "shapes", overwrite=True)
    return s.get(name)
