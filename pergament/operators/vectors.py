"""Embedding verification, always 1:1: a probe meets only the record it claims to be."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def as_doubles(c: Column) -> Column:
    return F.transform(c, lambda x: x.cast("double"))


def norm(c: Column) -> Column:
    return F.sqrt(F.aggregate(c, F.lit(0.0), lambda s, x: s + x * x))


def prepare_vectors(df: DataFrame, column: str = "embedding", min_norm: float = 1e-12, dimension: int | None = None) -> DataFrame:
    """E1. Adds reject (null, empty, non_finite, zero_norm, dimension or null) and unit, the L2-normalised doubles."""
    v = as_doubles(F.col(column))
    odd = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    reject = F.when(F.col(column).isNull(), "null").when(F.size(column) == 0, "empty").when(odd, "non_finite").when(norm(v) <= min_norm, "zero_norm")
    if dimension is not None:
        reject = reject.when(F.size(column) != dimension, "dimension")
    n = norm(v)
    return df.withColumn("reject", reject).withColumn("unit", F.when(F.col("reject").isNull(), F.transform(v, lambda x: x / n)))


def largest_per_image(faces: DataFrame, min_score: float = 0.60) -> DataFrame:
    """E2. Faces (image_id, pos, left, top, right, bottom, score) at min_score or more, the largest of each image."""
    size = (F.col("right") - F.col("left")) * (F.col("bottom") - F.col("top"))
    w = Window.partitionBy("image_id").orderBy(F.desc("area"), "pos")
    ranked = faces.where(F.col("score") >= min_score).withColumn("area", size)
    return ranked.withColumn("rank", F.row_number().over(w)).where("rank = 1").drop("rank")


def select_portrait(faces: DataFrame, images: DataFrame, min_score: float = 0.40) -> DataFrame:
    """E3. One portrait box per image and how it was found.

    faces also have pass ('image' or 'region'; region boxes relative to the region),
    images(image_id, width, height). First: whole-image faces with centre x in the left 55 %,
    centre y in 15 to 92 % and both sides 40 or more, best by area, then score, pos and edges. Second: the
    best region face, shifted back. Last: the fixed region with score 0.
    """
    x1, x2, y1, y2 = (F.floor(F.col("images." + d) * s) for d, s in (("width", 0.02), ("width", 0.37), ("height", 0.25), ("height", 0.94)))
    i = images.alias("images").select("images.*", x1.alias("x1"), x2.alias("x2"), y1.alias("y1"), y2.alias("y2"))
    f = faces.where(F.col("score") >= min_score).hint("merge").join(i.hint("merge"), "image_id")
    region = F.col("pass") == "region"
    f = f.withColumns({"left": F.when(region, F.col("left") + F.col("x1")).otherwise(F.col("left")), "right": F.when(region, F.col("right") + F.col("x1")).otherwise(F.col("right")), "top": F.when(region, F.col("top") + F.col("y1")).otherwise(F.col("top")), "bottom": F.when(region, F.col("bottom") + F.col("y1")).otherwise(F.col("bottom"))})
    wide, tall = F.col("right") - F.col("left"), F.col("bottom") - F.col("top")
    cx, cy = (F.col("left") + F.col("right")) / 2, (F.col("top") + F.col("bottom")) / 2
    fits = (cx <= 0.55 * F.col("width")) & cy.between(0.15 * F.col("height"), 0.92 * F.col("height")) & (wide >= 40) & (tall >= 40)
    f = f.withColumns({"area": wide * tall, "branch": F.when(~region & fits, 0).when(region, 1)}).where("branch IS NOT NULL")
    cols = ["image_id", "left", "top", "right", "bottom", "score"]
    fixed = i.select("image_id", *(F.col(c).cast("double").alias(n) for c, n in (("x1", "left"), ("y1", "top"), ("x2", "right"), ("y2", "bottom"))), F.lit(0.0).alias("score"), F.lit(2).alias("branch"), F.lit(0.0).alias("area"), F.lit(0).cast("long").alias("pos"))
    found = f.select(*(F.col(c).cast("double").alias(c) if c != "image_id" else c for c in cols), "branch", F.col("area").cast("double").alias("area"), F.col("pos").cast("long").alias("pos")).unionByName(fixed)
    w = Window.partitionBy("image_id").orderBy("branch", F.desc("area"), F.desc("score"), "pos", "left", "top")
    names = F.element_at(F.array(*map(F.lit, ("whole_image", "region", "fixed_region"))), F.col("branch") + 1)
    return found.withColumn("__n", F.row_number().over(w)).where("__n = 1").select(*cols, names.alias("method"))


def crop_box(df: DataFrame, margin: float = 0.25, lower: float = 0.45) -> DataFrame:
    """E4. Adds crop_left/top/right/bottom (ints, clipped to width and height) and crop_error where nothing is left."""
    w, h = F.col("right") - F.col("left"), F.col("bottom") - F.col("top")
    edge = lambda c, low, high: F.greatest(F.least(c, high), low).cast("int")
    zero = F.lit(0)
    out = df.withColumns({
        "crop_left": edge((F.col("left") - w * margin).cast("int"), zero, F.col("width")), "crop_top": edge((F.col("top") - h * margin).cast("int"), zero, F.col("height")),
        "crop_right": edge((F.col("right") + w * margin).cast("int"), zero, F.col("width")), "crop_bottom": edge((F.col("bottom") + h * lower).cast("int"), zero, F.col("height")),
    })
    return out.withColumn("crop_error", (F.col("crop_right") <= F.col("crop_left")) | (F.col("crop_bottom") <= F.col("crop_top")))


def verify_pairs(probes: DataFrame, enrolled: DataFrame, on: str = "subject_id", min_norm: float = 1e-12) -> DataFrame:
    """E5. Cosine similarity of each probe with the record it claims, clipped to [-1, 1], and distance.

    probes(on, probe_id, embedding), enrolled(on, embedding). Bad vectors, and vectors of
    different dimension, keep a row with reject and null similarity.
    """
    a = prepare_vectors(probes, min_norm=min_norm).select(on, "probe_id", F.col("unit").alias("u"), F.col("reject").alias("ra"))
    b = prepare_vectors(enrolled, min_norm=min_norm).select(on, F.col("unit").alias("v"), F.col("reject").alias("rb"))
    j = a.hint("merge").join(b.hint("merge"), on)
    dot = F.aggregate(F.zip_with("u", "v", lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    reject = F.coalesce("ra", "rb", F.when(F.size("u") != F.size("v"), "dimension"))
    sim = F.when(F.col("reject").isNull(), F.greatest(F.least(dot, F.lit(1.0)), F.lit(-1.0)))
    return j.withColumn("reject", reject).withColumn("similarity", sim).select(on, "probe_id", "reject", "similarity", (1 - F.col("similarity")).alias("distance"))


def decide(df: DataFrame, match: float = 0.5, review: float = 0.4, column: str = "similarity") -> DataFrame:
    """E6. Adds verdict (match, review, not_match; null for rejects), needs_review and message; similarity and distance rounded to 4."""
    if not -1 <= review < match <= 1:
        raise ValueError("thresholds need -1 <= review < match <= 1")
    s = F.col(column)
    verdict = F.when(s >= match, "match").when(s >= review, "review").when(s.isNotNull(), "not_match")
    message = F.when(F.col("verdict") == "match", "same person").when(F.col("verdict") == "review", "manual review needed").when(F.col("verdict") == "not_match", "not the same person")
    out = df.withColumn("verdict", verdict).withColumns({"needs_review": F.col("verdict") == "review", "message": message, column: F.round(s, 4)})
    return out.withColumn("distance", F.round("distance", 4)) if "distance" in df.columns else out


def screen_quads(quads: DataFrame, images: DataFrame, most: int = 80, min_area: float = 0.20, low: float = 1.35, high: float = 2.35, card: float = 85.60 / 53.98, floor: int = 64) -> DataFrame:
    """E7. Largest valid quadrilateral among the ``most`` largest of each image, its ordered corners and output size.

    quads(image_id, quad_id, corners array of [x, y], area). Valid: area at min_area of the
    image or more, long over short side within the bounds. The output keeps the card ratio,
    sides of ``floor`` pixels at least; rotate says that the card stands upright.
    """
    w = Window.partitionBy("image_id").orderBy(F.desc("area"), "quad_id")
    some = quads.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most).hint("merge").join(images.hint("merge"), "image_id")
    s, d = F.transform("corners", lambda p: p[0] + p[1]), F.transform("corners", lambda p: p[1] - p[0])
    pick = lambda by, value: F.get(F.filter(F.col("corners"), lambda p: by(p) == value), F.lit(0))
    plus, minus = (lambda p: p[0] + p[1]), (lambda p: p[1] - p[0])
    some = some.withColumns({"tl": pick(plus, F.array_min(s)), "br": pick(plus, F.array_max(s)), "tr": pick(minus, F.array_min(d)), "bl": pick(minus, F.array_max(d))})
    side = lambda a, b: F.sqrt(F.pow(F.col(a)[0] - F.col(b)[0], 2) + F.pow(F.col(a)[1] - F.col(b)[1], 2))
    some = some.withColumns({"wide": F.greatest(side("tl", "tr"), side("bl", "br")), "tall": F.greatest(side("tl", "bl"), side("tr", "br"))})
    long_, short = F.greatest("wide", "tall"), F.least("wide", "tall")
    good = some.where((F.col("area") >= min_area * F.col("width") * F.col("height")) & (short > 0)).where((long_ / short).between(low, high))
    best = good.withColumn("__n", F.row_number().over(w)).where("__n = 1")
    out_w = F.greatest(F.round(F.greatest("wide", "tall")), F.lit(float(floor))).cast("int")
    out_h = F.greatest(F.round(out_w / card), F.lit(float(floor))).cast("int")
    return best.select("image_id", "quad_id", "area", F.array("tl", "tr", "br", "bl").alias("corners"), out_w.alias("out_width"), out_h.alias("out_height"), (F.col("tall") > F.col("wide")).alias("rotate"))
