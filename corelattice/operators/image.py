"""Pixels, labels and shapes as tables: projection, scales, masks, core grids, measurement.

Pixels are long: ``image``, ``c`` (channel), ``y``, ``x``, ``value``; labels
``image``, ``y``, ``x``, ``label`` with 0 for background left out; shapes carry a
box ``xmin``, ``ymin``, ``xmax``, ``ymax``.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corelattice.functions.modularity import connected

PROJECTIONS = {"max": F.max, "mean": F.avg, "sum": F.sum, "median": F.median}


# pixels ---------------------------------------------------------------------


def project(pixels: DataFrame, channels: list[str], method: str) -> DataFrame:
    """One channel ``<method>[a_b]`` from several: ``image``, ``c``, ``y``, ``x``, ``value``."""
    if method not in PROJECTIONS:
        raise ValueError(f"unknown projection {method}")
    out = pixels.where(F.col("c").isin(channels)).groupBy("image", "y", "x").agg(PROJECTIONS[method]("value").alias("value"))
    return out.select("image", F.lit(f"{method}[{'_'.join(channels)}]").alias("c"), "y", "x", "value")


def corrected(v: Column, low: float, high: float, gamma: float = 1.0) -> Column:
    """Contrast between two limits, clipped to [0, high], to the power gamma."""
    return F.pow(F.least(F.greatest((v - low) / F.lit(high - low), F.lit(0.0)), F.lit(float(high))), F.lit(float(gamma)))


def pyramid(pixels: DataFrame, factor: int = 2) -> DataFrame:
    """The next coarser scale: means of squares of ``factor`` pixels."""
    d = pixels.withColumns({"y": F.floor(F.col("y") / factor).cast("int"), "x": F.floor(F.col("x") / factor).cast("int")})
    return d.groupBy("image", "c", "y", "x").agg(F.avg("value").alias("value"))


def downsampling_factor(full: tuple[int, int], small: tuple[int, int]) -> int:
    """The rounded ratio of two sizes, which must be the same on both axes."""
    a, b = round(full[0] / small[0]), round(full[1] / small[1])
    if a != b:
        raise ValueError(f"the axes differ: {a}, {b}")
    return a


def zero_outside(pixels: DataFrame, box: tuple[float, float, float, float]) -> DataFrame:
    """Values outside the box (xmin, ymin, xmax, ymax; both ends in) are 0."""
    inside = F.col("x").between(box[0], box[2]) & F.col("y").between(box[1], box[3])
    return pixels.withColumn("value", F.when(inside, F.col("value")).otherwise(0.0))


def um_to_px(um: Column, mpp: Column) -> Column:
    """Whole pixels of a length in micrometres, halves to even."""
    return F.bround(um / mpp).cast("long")


def affine(x: Column, y: Column, m: list[list[float]]) -> tuple[Column, Column]:
    """A point under a 3 x 3 matrix."""
    return tuple(F.lit(float(r[0])) * x + F.lit(float(r[1])) * y + F.lit(float(r[2])) for r in m[:2])


def area_threshold(diameter: float, expansion: float = 3.0, fraction: float = 1.0) -> float:
    """Area of a disc of the diameter, grown by ``expansion``, times ``fraction`` squared as to the radius."""
    return math.pi * (diameter / 2 + expansion) ** 2 * fraction


def per_image(pixels: DataFrame, fn, schema: str) -> DataFrame:
    """``fn`` on each image and channel as a dense array.

    An image is bounded by its height and width, whatever the number of images.
    """

    def run(t: pd.DataFrame) -> pd.DataFrame:
        y, x = t["y"].to_numpy(), t["x"].to_numpy()
        a = np.zeros((y.max() + 1, x.max() + 1))
        a[y, x] = t["value"].to_numpy()
        out = fn(np.nan_to_num(a))
        out.insert(0, "image", t["image"].iat[0])
        return out

    return pixels.groupBy("image").applyInPandas(run, schema)


def gaussian(a: np.ndarray, sigma: float) -> np.ndarray:
    """Gaussian blur, edges repeated."""
    if sigma <= 0:
        return a
    r = int(4 * sigma + 0.5)
    k = np.exp(-0.5 * (np.arange(-r, r + 1) / sigma) ** 2)
    k /= k.sum()
    for axis in (0, 1):
        pad = np.pad(a, [(r, r) if i == axis else (0, 0) for i in (0, 1)], mode="edge")
        n = a.shape[axis]
        a = sum(w * (pad[i : i + n] if axis == 0 else pad[:, i : i + n]) for i, w in enumerate(k))
    return a


def otsu(values: np.ndarray, bins: int = 256) -> float:
    """Threshold of greatest variance between two classes."""
    n, edges = np.histogram(values, bins)
    mid = (edges[:-1] + edges[1:]) / 2
    w = np.cumsum(n).astype(float)
    s = np.cumsum(n * mid)
    w2, s2 = w[-1] - w, s[-1] - s
    with np.errstate(divide="ignore", invalid="ignore"):
        between = w * w2 * (s / w - s2 / w2) ** 2
    return float(mid[np.nanargmax(between)]) if np.isfinite(between).any() else float(values.max(initial=0))


def components(mask: np.ndarray) -> np.ndarray:
    """Numbers of connected regions (8 neighbours) from 1, 0 outside."""
    h, w = mask.shape
    place = np.full((h + 2, w + 2), -1)
    place[1:-1, 1:-1][mask] = np.arange(mask.sum())
    own = place[1:-1, 1:-1][mask]
    ends = []
    for dy, dx in ((0, 1), (1, -1), (1, 0), (1, 1)):
        other = place[1 + dy : 1 + dy + h, 1 + dx : 1 + dx + w][mask]
        ends.append(np.stack([own[other >= 0], other[other >= 0]]))
    a, b = np.concatenate(ends, axis=1)
    out = np.zeros((h, w), np.int64)
    out[mask] = connected(len(own), a, b, np.zeros(len(own), np.int64)) + 1
    return out


def masks(pixels: DataFrame, sigma: float, least_area: float = 0.0, grow: int = 0) -> DataFrame:
    """Label pixels of blurred, thresholded regions: ``image``, ``y``, ``x``, ``label``.

    Regions smaller than ``least_area`` pixels are dropped; ``grow`` widens each
    mask by so many pixels first.
    """

    def run(a: np.ndarray) -> pd.DataFrame:
        b = gaussian(a, sigma)
        m = b > otsu(b.reshape(-1))
        for _ in range(grow):
            p = np.pad(m, 1)
            m = m | p[:-2, 1:-1] | p[2:, 1:-1] | p[1:-1, :-2] | p[1:-1, 2:]
        lab = components(m)
        size = np.bincount(lab.reshape(-1))
        y, x = np.nonzero((lab > 0) & (size[lab] >= least_area))
        return pd.DataFrame({"y": y.astype(np.int32), "x": x.astype(np.int32), "label": lab[y, x].astype(np.int32)})

    return per_image(pixels, run, "image string, y int, x int, label int")


def blobs(pixels: DataFrame, low: float, high: float, ratio: float = 1.6, threshold: float = 0.1, overlap: float = 0.5) -> DataFrame:
    """Bright round spots by differences of Gaussians: ``image``, ``y``, ``x``, ``radius`` = sigma * sqrt 2.

    Local maxima over place and scale above ``threshold`` times the greatest
    value; of two that overlap more than ``overlap`` of the smaller one's width the
    larger stays.
    """

    def run(a: np.ndarray) -> pd.DataFrame:
        a = a / max(a.max(), 1e-12)
        k = int(math.log(high / low) / math.log(ratio)) + 1
        s = [low * ratio**i for i in range(k + 1)]
        g = [gaussian(a, v) for v in s]
        dog = np.stack([(g[i] - g[i + 1]) / (ratio - 1) for i in range(k)])
        p = np.pad(dog, 1, constant_values=-np.inf)
        top = np.full(dog.shape, -np.inf)
        for i in range(3):
            for j in range(3):
                for m in range(3):
                    np.maximum(top, p[i : i + dog.shape[0], j : j + dog.shape[1], m : m + dog.shape[2]], out=top)
        z, y, x = np.nonzero((dog == top) & (dog > threshold * max(dog.max(), 1e-12)))
        order = np.argsort(-np.array([s[i] for i in z])) if len(z) else np.empty(0, int)
        kept: list[tuple[int, int, float]] = []
        for i in order:
            r = s[z[i]] * math.sqrt(2)
            if all(r + q - math.hypot(y[i] - b, x[i] - c) <= overlap * 2 * min(r, q) for b, c, q in kept):
                kept.append((int(y[i]), int(x[i]), r))
        return pd.DataFrame(kept, columns=["y", "x", "radius"]).astype({"y": "int32", "x": "int32", "radius": "float64"})

    return per_image(pixels, run, "image string, y int, x int, radius double")


# labels ---------------------------------------------------------------------


def measure(labels: DataFrame, pixels: DataFrame, how: str = "mean") -> DataFrame:
    """``image``, ``label``, ``c``, ``intensity``, ``area``, ``centroid_x``, ``centroid_y``, ``eccentricity``, axis lengths, ``orientation``.

    Labels meet pixels on (image, y, x).  The shape follows from second moments
    in closed form (with 1/12 for the pixel's own extent).  ``intensity``: mean or
    median over the label's pixels of the channel.
    """
    if how not in ("mean", "median"):
        raise ValueError(f"unknown intensity {how}")
    lab = labels.where("label <> 0")
    shape = lab.groupBy("image", "label").agg(F.count(F.lit(1)).alias("area"), F.avg("x").alias("centroid_x"), F.avg("y").alias("centroid_y"), F.var_pop("x").alias("a"), F.var_pop("y").alias("b"), F.covar_pop("x", "y").alias("c2"))
    a, b, c = F.col("a") + 1 / 12, F.col("b") + 1 / 12, F.col("c2")
    root = F.sqrt((a - b) * (a - b) + 4 * c * c)
    l1, l2 = (a + b + root) / 2, F.greatest((a + b - root) / 2, F.lit(0.0))
    shape = shape.select(
        "image", "label", "area", "centroid_x", "centroid_y", F.sqrt(1 - l2 / l1).alias("eccentricity"),
        (4 * F.sqrt(l1)).alias("major_axis"), (4 * F.sqrt(l2)).alias("minor_axis"), (0.5 * F.atan2(2 * c, a - b)).alias("orientation"),
    )
    met = lab.join(pixels, ["image", "y", "x"])
    inten = met.groupBy("image", "label", "c").agg((F.avg("value") if how == "mean" else F.median("value")).alias("intensity"))
    return shape.join(inten, ["image", "label"], "left")


def cell_ids(shapes: DataFrame, tile: str | None = None) -> DataFrame:
    """``cell_id``: the 1-based place of the label within its image (and tile), and the tile's name or ``global``."""
    by = Window.partitionBy("image", *([tile] if tile else [])).orderBy("label")
    return shapes.withColumn("cell_id", F.concat_ws("_", F.row_number().over(by).cast("string"), F.col(tile) if tile else F.lit("global")))


def merged_tiles(labels: DataFrame) -> DataFrame:
    """Labels of tiles made unique in the image: each tile's are raised by the greatest labels of the tiles before it.

    ``labels`` has ``image``, ``tile``, ``y``, ``x``, ``label``.
    """
    top = labels.groupBy("image", "tile").agg(F.max("label").alias("top"))
    shift = F.sum("top").over(Window.partitionBy("image").orderBy("tile").rowsBetween(Window.unboundedPreceding, 0)) - F.col("top")
    return labels.join(top.select("image", "tile", shift.alias("shift")), ["image", "tile"]).withColumn("label", F.when(F.col("label") > 0, F.col("label") + F.col("shift")).otherwise(0).cast("long")).drop("shift")


def grown(labels: DataFrame, distance: int) -> DataFrame:
    """Labels widened by a distance: a free pixel takes the nearest label, ties to the lesser one."""
    steps = [(dy, dx) for dy in range(-distance, distance + 1) for dx in range(-distance, distance + 1) if dy * dy + dx * dx <= distance * distance]
    ring = F.array(*[F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx"), F.lit(dy * dy + dx * dx).alias("d")) for dy, dx in steps])
    near = labels.where("label <> 0").withColumn("s", F.explode(ring)).select("image", (F.col("y") + F.col("s.dy")).alias("y"), (F.col("x") + F.col("s.dx")).alias("x"), F.struct("s.d", "label").alias("best"))
    return near.groupBy("image", "y", "x").agg(F.min("best").alias("best")).select("image", "y", "x", F.col("best.label").alias("label")).where("y >= 0 and x >= 0")


# shapes ---------------------------------------------------------------------


def boxes(labels: DataFrame, pad: int = 0) -> DataFrame:
    """Bounds of every label, widened by ``pad``."""
    return labels.where("label <> 0").groupBy("image", "label").agg(*[(f(c) + s * pad).alias(o) for f, c, s, o in ((F.min, "x", -1, "xmin"), (F.min, "y", -1, "ymin"), (F.max, "x", 1, "xmax"), (F.max, "y", 1, "ymax"))])


def disc_boxes(discs: DataFrame, x: str, y: str, radius: str) -> DataFrame:
    """Adds the box of each disc."""
    return discs.withColumns({"xmin": F.col(x) - F.col(radius), "ymin": F.col(y) - F.col(radius), "xmax": F.col(x) + F.col(radius), "ymax": F.col(y) + F.col(radius)})


def box_overlaps(left: DataFrame, right: DataFrame, group: str, left_key: str, right_key: str, side: float, how: str = "inner") -> DataFrame:
    """Keys and boxes of pairs of boxes of a group that touch, through a grid of squares of ``side``.

    A pair is reported from the one square that holds the lower corner of its
    intersection, so no pair comes twice.  ``how`` = ``left`` keeps left boxes
    without a partner.
    """

    def tiled(df: DataFrame, key: str, s: str) -> DataFrame:
        d = df.where("xmin is not null and ymin is not null and xmax is not null and ymax is not null").select(F.col(group).alias("g"), F.col(key).alias(f"k{s}"), *[F.col(c).cast("double").alias(f"{c}{s}") for c in ("xmin", "ymin", "xmax", "ymax")])
        d = d.withColumn("tx", F.explode(F.sequence(F.floor(F.col(f"xmin{s}") / side), F.floor(F.col(f"xmax{s}") / side))))
        return d.withColumn("ty", F.explode(F.sequence(F.floor(F.col(f"ymin{s}") / side), F.floor(F.col(f"ymax{s}") / side))))

    met = tiled(left, left_key, "1").join(tiled(right, right_key, "2"), ["g", "tx", "ty"])
    met = met.where("xmin1 <= xmax2 and xmin2 <= xmax1 and ymin1 <= ymax2 and ymin2 <= ymax1")
    met = met.where((F.floor(F.greatest("xmin1", "xmin2") / side) == F.col("tx")) & (F.floor(F.greatest("ymin1", "ymin2") / side) == F.col("ty"))).drop("tx", "ty")
    if how == "left":
        rest = left.select(F.col(group).alias("g"), F.col(left_key).alias("k1"), *[F.col(c).cast("double").alias(f"{c}1") for c in ("xmin", "ymin", "xmax", "ymax")]).join(met.select("g", "k1").distinct(), ["g", "k1"], "left_anti")
        met = met.unionByName(rest, allowMissingColumns=True)
    return met.withColumnRenamed("g", group)


def envelopes(cores: DataFrame, masks_: DataFrame, group: str, core_key: str, mask_key: str, side: float) -> DataFrame:
    """``group``, core, and the bounds of the core's box and all mask boxes that touch it."""
    met = box_overlaps(cores, masks_, group, core_key, mask_key, side, "left")
    return met.groupBy(group, F.col("k1").alias(core_key)).agg(
        F.least(F.min("xmin1"), F.min("xmin2")).alias("xmin"), F.least(F.min("ymin1"), F.min("ymin2")).alias("ymin"),
        F.greatest(F.max("xmax1"), F.max("xmax2")).alias("xmax"), F.greatest(F.max("ymax1"), F.max("ymax2")).alias("ymax"),
    )


def rotation(points: DataFrame, group: str, key: str, x: str, y: str, diameter: Column) -> DataFrame:
    """``group``, ``angle``: median angle in degrees over pairs with dx > 2 d and |dy| < d; 0 without pairs.

    Pairs meet in bands of ``y`` of height d (``d``: one number for each group), so
    only points of one row of cores are compared.
    """
    p = points.where(f"{x} is not null and {y} is not null").select(F.col(group).alias("g"), F.col(key).alias("k"), F.col(x).alias("x"), F.col(y).alias("y"), diameter.alias("d")).where("d > 0")
    p = p.withColumn("band", F.floor(F.col("y") / F.col("d")))
    q = p.select("g", F.col("x").alias("x2"), F.col("y").alias("y2"), F.explode(F.array(F.col("band") - 1, F.col("band"), F.col("band") + 1)).alias("band"))
    met = p.join(q, ["g", "band"]).where("x2 - x > 2 * d and abs(y2 - y) < d")
    angle = met.groupBy("g").agg(F.median(F.degrees(F.atan2(F.col("y2") - F.col("y"), F.col("x2") - F.col("x")))).alias("angle"))
    return p.select("g").distinct().join(angle, "g", "left").select(F.col("g").alias(group), F.coalesce("angle", F.lit(0.0)).alias("angle"))


def gap_walk(points: DataFrame, group: str, v: str, gap: Column | float, out: str = "line") -> DataFrame:
    """Rows or columns of a grid: points in the order of ``v``; a step of more than ``gap`` begins a new line.

    ``group``, ``line`` (from 0), ``centre`` (mean), ``n``.  A lone last point is a
    line of its own.
    """
    d = points.where(F.col(v).isNotNull()).withColumn("__gap", gap if isinstance(gap, Column) else F.lit(float(gap)))
    w = Window.partitionBy(group).orderBy(v)
    d = d.withColumn("__new", (F.col(v) - F.lag(v).over(w) > F.col("__gap")).cast("int"))
    d = d.withColumn(out, F.sum(F.coalesce("__new", F.lit(0))).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return d.groupBy(group, out).agg(F.avg(v).alias("centre"), F.count(F.lit(1)).alias("n"))


def grid_label(row: Column, column: Column) -> Column:
    """``A-1`` for row 0, column 0; rows past Z go on with AA, AB, ..."""
    letter = F.chr(65 + row % 26)
    head = F.when(row >= 26, F.chr(64 + F.floor(row / 26).cast("int"))).otherwise("")
    return F.concat(head, letter, F.lit("-"), (column + 1).cast("string"))


def grid_points(rows: DataFrame, columns: DataFrame, group: str) -> DataFrame:
    """``group``, ``row``, ``col``, ``gx``, ``gy``, ``label``: crossings of a group's lines."""
    out = rows.select(group, F.col("line").alias("row"), F.col("centre").alias("gy")).join(columns.select(group, F.col("line").alias("col"), F.col("centre").alias("gx")), group)
    return out.withColumn("label", grid_label(F.col("row"), F.col("col")))


def match_grid(grid: DataFrame, discs: DataFrame, group: str, key: str, x: str, y: str, radius: str, reach: float = 1.25) -> DataFrame:
    """``group``, ``label``, ``key`` (NULL: no core there), ``distance``: each crossing's nearest disc.

    Within ``reach`` times the group's mean radius; a disc goes to the nearest of
    the crossings that chose it (ties by label).  A group's grid is one slide's, so
    the pairs of a group are bounded by its rows, columns and cores.
    """
    d = discs.where(f"{x} is not null and {y} is not null").select(F.col(group).alias("g"), F.col(key).alias("k"), F.col(x).alias("x"), F.col(y).alias("y"), F.avg(radius).over(Window.partitionBy(group)).alias("r"))
    met = grid.withColumnRenamed(group, "g").join(d, "g").withColumn("distance", F.hypot(F.col("gx") - F.col("x"), F.col("gy") - F.col("y"))).where(F.col("distance") <= reach * F.col("r"))
    best = met.withColumn("a", F.row_number().over(Window.partitionBy("g", "label").orderBy("distance", "k"))).where("a = 1")
    best = best.withColumn("b", F.row_number().over(Window.partitionBy("g", "k").orderBy("distance", "label"))).where("b = 1")
    out = grid.withColumnRenamed(group, "g").select("g", "label").join(best.select("g", "label", "k", "distance"), ["g", "label"], "left")
    return out.select(F.col("g").alias(group), "label", F.col("k").alias(key), "distance")


def overlapping_discs(discs: DataFrame, group: str, key: str, x: str, y: str, radius: str, side: float) -> DataFrame:
    """Pairs ``a`` < ``b`` of discs of a group that overlap."""
    d = disc_boxes(discs, x, y, radius)
    met = box_overlaps(d, d, group, key, key, side).where("k1 < k2")
    mid = lambda a, b, s: (F.col(f"{a}{s}") + F.col(f"{b}{s}")) / 2
    r = lambda s: (F.col(f"xmax{s}") - F.col(f"xmin{s}")) / 2
    dist = F.hypot(mid("xmin", "xmax", 1) - mid("xmin", "xmax", 2), mid("ymin", "ymax", 1) - mid("ymin", "ymax", 2))
    return met.where(dist < r(1) + r(2)).select(group, F.col("k1").alias("a"), F.col("k2").alias("b"))


def deleted(before: DataFrame, after: DataFrame, keys: list[str]) -> DataFrame:
    """Shapes of ``before`` whose box is not in ``after``; equal NULLs match."""
    b = after.select(*[F.col(k).alias(f"__{k}") for k in keys]).distinct()
    return before.join(b, [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys], "left_anti")
