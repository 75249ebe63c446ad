"""Points near other points, and regions that contain points.

Points carry the Z-order code of their finest square.  A disc or another region
is covered by quads of a level that follows its own size, so that a region of
any size has a bounded number of them; within each quad the codes of the two
corners of the part of its box that lies there bound a range of codes.  Points
and ranges meet in a join on (group, quad), the common prefix of the codes,
with ``lo <= code <= hi``, which Spark runs as a sort-merge join with skew
splitting; every candidate is then measured exactly.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corelattice.functions import curve
from corelattice.plans.lineage import written

FEWEST = 8  # quads across a region are between FEWEST / 2 and FEWEST


def _cover(df: DataFrame, box: tuple[str, str, str, str], level: int, kept: Column | None = None, block: Column | None = None) -> DataFrame:
    """One row for each quad of ``level`` that the box (xmin, ymin, xmax, ymax) touches: ``__block``, and the range ``__lo`` to ``__hi`` of codes there.

    ``kept``: a condition on the quad ``__qx``, ``__qy``; ``block``: one on its number.
    """
    ends = {"x": (F.col(box[0]), F.col(box[2])), "y": (F.col(box[1]), F.col(box[3]))}
    out = df
    for axis, (low, high) in ends.items():
        out = out.withColumn(f"__q{axis}", F.explode(F.sequence(curve.square(low, level), curve.square(high, level))))
    if kept is not None:
        out = out.where(kept)
    out = curve.interleaved(out, F.col("__qx"), F.col("__qy"), "__block")
    if block is not None:
        out = out.where(block)
    for axis, (low, high) in ends.items():  # the box within the quad, counted from the quad's corner
        first = F.shiftleft(f"__q{axis}", level)
        out = out.withColumn(f"__a{axis}", F.greatest(curve.square(low) - first, F.lit(0).cast("long"))).withColumn(f"__b{axis}", F.least(curve.square(high) - first, F.lit((1 << level) - 1).cast("long")))
    for end, code in (("a", "__lo"), ("b", "__hi")):
        out = curve.interleaved(out, F.col(f"__{end}x"), F.col(f"__{end}y"), "__in", level)
        out = out.withColumn(code, F.shiftleft("__block", 2 * level).bitwiseOR(F.col("__in"))).drop("__in")
    return out.drop("__ax", "__ay", "__bx", "__by", "__qx", "__qy")


def _touched(x: str, y: str, radius: Column, level: int) -> Column:
    """Whether the disc reaches the quad ``__qx``, ``__qy``."""
    side = curve.BASE * 2**level

    def gap(q: str, v: str) -> Column:  # from the centre to the quad along one axis
        low = (F.col(q) - F.lit(curve._SHIFT >> level)) * F.lit(side)
        return F.greatest(low - F.col(v), F.col(v) - low - F.lit(side), F.lit(0.0))

    return gap("__qx", x) * gap("__qx", x) + gap("__qy", y) * gap("__qy", y) <= radius * radius * (1 + 1e-12)


def _coded(df: DataFrame, x: str, y: str, level: int) -> DataFrame:
    return curve.coded(df, x, y, "__code").withColumn("__block", F.shiftright("__code", 2 * level))


def _boxed(df: DataFrame, x: str, y: str, radius: Column) -> DataFrame:
    return df.withColumns({"__x0": F.col(x) - radius, "__y0": F.col(y) - radius, "__x1": F.col(x) + radius, "__y1": F.col(y) + radius})


_BOX = ("__x0", "__y0", "__x1", "__y1")


def _square(a: str, b: str) -> Column:
    return (F.col(a) - F.col(b)) * (F.col(a) - F.col(b))


def near_pairs(points: DataFrame, group: str, key: str, x: str, y: str, radius: float) -> DataFrame:
    """Pairs of points of one group at most ``radius`` apart: group, ``key_a`` < ``key_b``, ``distance``.

    A NULL or NaN coordinate, a NULL group or key gives no row.  Points at one
    place are pairs of distance 0; rows that repeat a key give no pair with
    themselves.  Each unordered pair of quads is probed from one side only, so
    a disc is sent to about two quads.
    """
    level = curve.level_for(2 * radius)
    r = F.lit(float(radius))
    clean = points.select(F.col(group).alias("__g"), F.col(key).alias("__k"), F.col(x).alias("__x"), F.col(y).alias("__y"))
    clean = clean.where("__g is not null and __k is not null and __x is not null and __y is not null and not isnan(__x) and not isnan(__y)")
    pts = _coded(clean, "__x", "__y", level)
    discs = _cover(_boxed(pts.drop("__code").withColumnRenamed("__block", "__own"), "__x", "__y", r), _BOX, level, _touched("__x", "__y", r, level), F.col("__block") >= F.col("__own"))
    discs = discs.select("__g", "__block", "__lo", "__hi", "__own", F.col("__k").alias("__k2"), F.col("__x").alias("__x2"), F.col("__y").alias("__y2"))
    met = pts.join(discs, ["__g", "__block"]).where(
        F.col("__code").between(F.col("__lo"), F.col("__hi"))
        & ((F.col("__block") > F.col("__own")) & (F.col("__k") != F.col("__k2")) | (F.col("__k") > F.col("__k2")) & (F.col("__block") == F.col("__own")))
    )
    d2 = _square("__x", "__x2") + _square("__y", "__y2")
    return met.where(d2 <= r * r).select(
        F.col("__g").alias(group), F.least("__k", "__k2").alias("key_a"), F.greatest("__k", "__k2").alias("key_b"), F.sqrt(d2).alias("distance")
    )


def _in_regions(points: DataFrame, regions: DataFrame, group: str, key: str, x: str, y: str, touched, inside: Column, kept: list[Column]) -> DataFrame:
    """Points that meet regions (``__g``, ``__k2``, a box, whatever ``inside`` needs), level by level of the regions' sizes."""
    p = points.select(F.col(group).alias("__g"), F.col(key).alias("__k"), F.col(x).alias("__x"), F.col(y).alias("__y"))
    p = p.where("__g is not null and __k is not null and __x is not null and __y is not null and not isnan(__x) and not isnan(__y)")
    wide = F.greatest(F.col("__x1") - F.col("__x0"), F.col("__y1") - F.col("__y0"), F.lit(curve.BASE))
    # read once for every level
    regions = written(regions.withColumn("__level", F.greatest(F.ceil(F.log2(wide / F.lit(FEWEST * curve.BASE))), F.lit(0)).cast("int")), "regions")
    out = None
    for level in sorted(r[0] for r in regions.select("__level").distinct().collect()):  # 26 at most
        d = _cover(regions.where(F.col("__level") == level), _BOX, level, touched(level) if touched else None)
        met = _coded(p, "__x", "__y", level).join(d.drop(*_BOX), ["__g", "__block"])
        met = met.where(F.col("__code").between(F.col("__lo"), F.col("__hi")) & inside).select(F.col("__g").alias(group), F.col("__k").alias("key_a"), F.col("__k2").alias("key_b"), *kept)
        out = met if out is None else out.unionByName(met)
    if out is None:
        out = p.join(regions.limit(0), "__g").where(inside).select(F.col("__g").alias(group), F.col("__k").alias("key_a"), F.col("__k2").alias("key_b"), *kept)
    return out


def inside_discs(points: DataFrame, discs: DataFrame, group: str, key: str, x: str, y: str, disc_key: str, cx: str, cy: str, radius: str) -> DataFrame:
    """Points within discs of their group: group, ``key_a`` (point), ``key_b`` (disc), ``distance`` (from the centre).

    Overlapping discs give a row each.  NULL coordinates, groups or radii give
    none.
    """
    d = discs.select(F.col(group).alias("__g"), F.col(disc_key).alias("__k2"), F.col(cx).alias("__x2"), F.col(cy).alias("__y2"), F.col(radius).alias("__r"))
    d = d.where("__g is not null and __k2 is not null and __r >= 0 and not isnan(__r) and not isnan(__x2) and not isnan(__y2)")
    d2 = _square("__x", "__x2") + _square("__y", "__y2")
    return _in_regions(
        points, _boxed(d, "__x2", "__y2", F.col("__r")), group, key, x, y,
        lambda level: _touched("__x2", "__y2", F.col("__r"), level), d2 <= F.col("__r") * F.col("__r"), [F.sqrt(d2).alias("distance")],
    )


def vertices(wkt: str) -> Column:
    """The ring of a polygon text as an array of (x, y), first and last vertex alike; NULL for fewer than three vertices.

    Case, blanks and exponents in the text have no meaning.
    """
    number = f"transform(regexp_extract_all({wkt}, '{_NUMBER}', 1), v -> cast(v as double))"
    pairs = F.transform(F.array(F.expr(number)), lambda n: F.when(F.size(n) >= 8, F.transform(F.sequence(F.lit(0), (F.size(n) / 2).cast("int") - 1), lambda i: F.struct(F.get(n, 2 * i).alias("x"), F.get(n, 2 * i + 1).alias("y")))))
    return F.get(pairs, F.lit(0))


def in_polygon(ring: Column, x: Column, y: Column) -> Column:
    """Whether the point lies inside the ring, by the parity of the edges to its right."""

    def crossed(i: Column) -> Column:
        a, b = F.get(ring, i), F.get(ring, i + 1)
        return ((a["y"] > y) != (b["y"] > y)) & (x < (b["x"] - a["x"]) * (y - a["y"]) / (b["y"] - a["y"]) + a["x"])

    return F.aggregate(F.sequence(F.lit(0), F.size(ring) - 2), F.lit(False), lambda odd, i: odd != F.coalesce(crossed(i), F.lit(False)))


def inside_polygons(points: DataFrame, polygons: DataFrame, group: str, key: str, x: str, y: str, polygon_key: str, ring: str) -> DataFrame:
    """Points within polygons of their group: group, ``key_a`` (point), ``key_b`` (polygon).

    ``ring`` is an array of (x, y) as ``vertices`` gives it.  Polygons may overlap
    and need not be convex; a point on an edge may or may not count.  NULL rings,
    coordinates or groups give no row.
    """
    r = F.col("__ring")
    d = polygons.select(F.col(group).alias("__g"), F.col(polygon_key).alias("__k2"), F.col(ring).alias("__ring")).where("__g is not null and __k2 is not null and size(__ring) >= 4")
    for axis in ("x", "y"):
        values = F.col("__ring")[axis]  # of all vertices
        d = d.withColumns({f"__{axis}0": F.array_min(values), f"__{axis}1": F.array_max(values)})
    d = d.where("__x0 is not null and __y0 is not null and not isnan(__x1) and not isnan(__y1)")
    return _in_regions(points, d, group, key, x, y, None, in_polygon(r, F.col("__x"), F.col("__y")), [])


# a signed decimal number, with or without an exponent
_NUMBER = r"(-?[0-9]+\\.?[0-9]*(?:[eE][-+]?[0-9]+)?)"


def disc_of_polygon(df: DataFrame, wkt: str, x: str, y: str, radius: str) -> DataFrame:
    """Fill NULL ``x``, ``y``, ``radius`` from the polygon text ``wkt`` of a circle.

    The centre is the mean of the vertices (the closing one left out), the radius
    the mean distance of the vertices from the centre.  Case, blanks and
    exponents in the text have no meaning.  NULL stays where both are missing.
    """
    nums = F.when(F.col(x).isNull() | F.col(y).isNull() | F.col(radius).isNull() | F.isnan(radius), F.expr(f"transform(regexp_extract_all({wkt}, '{_NUMBER}', 1), v -> cast(v as double))"))
    out = df.withColumn("__n", nums).withColumn("__m", F.expr("int(size(__n) / 2) - 1"))
    vertices = "transform(sequence(0, __m - 1), i -> named_struct('x', __n[2 * i], 'y', __n[2 * i + 1]))"
    out = out.withColumn("__v", F.expr(f"case when __m > 0 then {vertices} end"))
    for c in ("x", "y"):
        own = x if c == "x" else y
        out = out.withColumn(own, F.coalesce(F.col(own), F.expr(f"aggregate(__v, 0d, (a, p) -> a + p.{c}) / __m")))
    dist = f"aggregate(__v, 0d, (a, p) -> a + sqrt(power(p.x - {x}, 2) + power(p.y - {y}, 2))) / __m"
    return out.withColumn(radius, F.coalesce(F.nanvl(F.col(radius), F.lit(None).cast("double")), F.expr(dist))).drop("__n", "__m", "__v")


def in_micrometres(df: DataFrame, images: DataFrame, columns: list[str], system: str = "coord_system") -> DataFrame:
    """``columns`` times the image's micrometres per pixel where ``system`` is ``global``.

    An image without a scale gives NULL; the other columns stay as they are.
    """
    scale = images.select("image", F.col("mpp").alias("__mpp")).dropDuplicates(["image"])
    out = df.join(scale, "image", "left")
    for c in columns:
        out = out.withColumn(c, F.when(F.col(system) == "um", F.col(c)).when(F.col(system) == "global", F.col(c) * F.col("__mpp")))
    return out.drop("__mpp")
