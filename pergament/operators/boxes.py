"""Box-table operators: filters, orders, duplicate suppression, line and row grouping, regions, pair geometry.

boxes(doc_id, box_id, text, left, top, right, bottom, confidence). Every operator works
within a document; greedy folds work within a vertical island of a document (boxes cut
where the top lies at or below every earlier bottom), which never changes their result, so
one very long document is many small groups.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pergament.functions import tables as T
from pergament.functions import text as X
from pergament.functions.numbers import rounded
from pergament.operators.dictionary import FEW_VALUES, remembered
from pergament.sources.scratch import stored

EDGES = ("left", "top", "right", "bottom")


def with_geometry(df: DataFrame) -> DataFrame:
    """Adds width, height, area and centre from the edges."""
    w, h = F.col("right") - F.col("left"), F.col("bottom") - F.col("top")
    return df.withColumns({"width": w, "height": h, "area": w * h, "center_x": (F.col("left") + F.col("right")) / 2, "center_y": (F.col("top") + F.col("bottom")) / 2})


# ---- B1 to B3


def normalize_boxes(df: DataFrame, remove_empty: bool = True) -> DataFrame:
    """B1. Four corners [x, y] to edges, ordered corners and geometry.

    Corners become top-left, top-right, bottom-right, bottom-left: the two smallest y (then
    x) are the top. Confidence is clamped to [0, 1], unparsable is 0. Rows without four
    corners are dropped; empty text or zero size is dropped on request.
    """
    xs, ys = F.transform("corners", lambda p: p[0]), F.transform("corners", lambda p: p[1])
    ordered = F.array_sort(F.transform("corners", lambda p: F.struct(p[1].alias("y"), p[0].alias("x"))))
    top = F.array_sort(F.transform(F.slice(ordered, 1, 2), lambda p: F.struct(p.x.alias("x"), p.y.alias("y"))))
    low = F.array_sort(F.transform(F.slice(ordered, 3, 2), lambda p: F.struct(p.x.alias("x"), p.y.alias("y"))))
    good = (F.size("corners") == 4) & ~F.exists("corners", lambda p: (F.size(p) < 2) | F.get(p, F.lit(0)).isNull() | F.get(p, F.lit(1)).isNull())
    score = F.coalesce(F.col("confidence").try_cast("double"), F.lit(0.0))
    out = (
        df.where(F.coalesce(good, F.lit(False)))
        .withColumns({"left": F.array_min(xs), "right": F.array_max(xs), "top": F.array_min(ys), "bottom": F.array_max(ys), "confidence": F.least(F.greatest(F.when(F.isnan(score), 0.0).otherwise(score), F.lit(0.0)), F.lit(1.0))})
        .withColumn("corners", F.array(top[0], top[1], low[1], low[0]))
    )
    out = with_geometry(out)
    return out.where((F.trim("text") != "") & (F.col("width") > 0) & (F.col("height") > 0)) if remove_empty else out


def filter_confidence(df: DataFrame, minimum: float = 0.05) -> DataFrame:
    """B2, inclusive."""
    return df.where(F.col("confidence") >= minimum)


def filter_min_size(df: DataFrame, width: float = 2.0, height: float = 2.0) -> DataFrame:
    """B3, inclusive."""
    return df.where((F.col("right") - F.col("left") >= width) & (F.col("bottom") - F.col("top") >= height))


# ---- B5


def order_columns(kind: str) -> list[Column]:
    cx, cy = F.col("left"), (F.col("top") + F.col("bottom")) / 2
    return {"left": [cx, cy], "top": [F.col("top"), F.col("left")], "reading": [cy, F.col("left")]}[kind] + [F.col("box_id")]


def order_boxes(df: DataFrame, kind: str = "reading") -> DataFrame:
    """B5. Adds pos (from 1) in left, top or reading order; box_id breaks ties."""
    return df.withColumn("pos", F.row_number().over(Window.partitionBy("doc_id").orderBy(*order_columns(kind))))


# ---- islands


def with_islands(df: DataFrame) -> DataFrame:
    """Adds island: boxes that no horizontal cut separates."""
    w = Window.partitionBy("doc_id").orderBy("top", "left", "box_id")
    edge = F.max("bottom").over(w.rowsBetween(Window.unboundedPreceding, -1))
    marked = df.withColumn("__cut", F.when(edge.isNull() | (F.col("top") >= edge), 1).otherwise(0))
    return marked.withColumn("island", F.sum("__cut").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("__cut")


# ---- B4


def overlap(a: str, b: str, low: str, high: str) -> Column:
    return F.greatest(F.least(F.col(f"{a}.{high}"), F.col(f"{b}.{high}")) - F.greatest(F.col(f"{a}.{low}"), F.col(f"{b}.{low}")), F.lit(0.0))


def area(a: str) -> Column:
    return (F.col(f"{a}.right") - F.col(f"{a}.left")) * (F.col(f"{a}.bottom") - F.col(f"{a}.top"))


def ratio(n: Column, d: Column) -> Column:
    return F.when(d > 0, n / d).otherwise(0.0)


def iou(a: str, b: str) -> Column:
    both = overlap(a, b, "left", "right") * overlap(a, b, "top", "bottom")
    return ratio(both, area(a) + area(b) - both)


def suppress_duplicates(df: DataFrame, min_iou: float = 0.8, compare_text: bool = True) -> DataFrame:
    """B4. Greedy: by confidence, then area, a box goes when a kept box overlaps it and says the same.

    A suppressed box suppresses nothing. Boxes can only meet within an island where no gap
    parts them in x. A box alone between two gaps stays, and one of two is judged by a look at
    its neighbour, both in the windows that find islands and gaps; they share one shuffle by
    document. Only boxes of larger parts are grouped, by text key and once more by gaps.
    """
    if min_iou <= 0:
        raise ValueError("min_iou must be above 0")
    w = Window.partitionBy("doc_id", "island").orderBy("left", "right", "box_id")
    cut = with_islands(df).withColumn("__cut", gaps(w))
    looks = {f"__{c}": F.lead(c).over(w) for c in dict.fromkeys(["box_id", *EDGES, "confidence", *(["text"] if compare_text else [])])}
    cut = cut.withColumns({"__after": F.lead("__cut", 1, 1).over(w), "__beyond": F.lead("__cut", 2, 1).over(w), **looks})
    # of a part of two the first box tells which one goes: the second (1), itself (2), none (0), or open (3)
    span = lambda low, high: F.greatest(F.least(F.col(high), F.col(f"__{high}")) - F.greatest(F.col(low), F.col(f"__{low}")), F.lit(0.0))
    own = lambda x: (F.col(f"{x}right") - F.col(f"{x}left")) * (F.col(f"{x}bottom") - F.col(f"{x}top"))
    both = span("left", "right") * span("top", "bottom")
    same = F.coalesce(ratio(both, own("") + own("__") - both) >= min_iou, F.lit(False))
    if compare_text:
        same = same & X.key("text", "alnum").eqNullSafe(X.key("__text", "alnum"))
    rank = lambda x: F.struct((-F.col(f"{x}confidence")).alias("c"), (-own(x)).alias("a"), F.col(f"{x}box_id").alias("id"))
    pair = (F.col("__cut") == 1) & (F.col("__after") == 0) & (F.col("__beyond") == 1)
    verdict = F.when(pair, F.when(~same, 0).when(rank("") < rank("__"), 1).when(rank("__") < rank(""), 2).otherwise(3))
    told = cut.withColumn("__own", verdict)
    told = told.withColumn("__told", F.when((F.col("__cut") == 0) & (F.col("__after") == 1), F.lag("__own").over(w)))
    alone = (F.col("__cut") == 1) & (F.col("__after") == 1)
    state = F.when(alone | (F.col("__own") < 2) | F.col("__told").isin(0, 2), 1).when((F.col("__own") == 2) | (F.col("__told") == 1), 0).otherwise(2)
    judged = stored(told.select(*df.columns, "island", state.alias("__state")), "judged")
    clear, open_ = judged.where("__state = 1").select(*df.columns), judged.where("__state = 2").drop("__state")
    return clear.unionByName(_folded(open_, df.columns, X.key("text", "alnum") if compare_text else F.lit(""), min_iou))


def gaps(w) -> Column:
    """1 where a box begins at or right of every edge before it in the window, else 0."""
    edge = F.max("right").over(w.rowsBetween(Window.unboundedPreceding, -1))
    return F.when(edge.isNull() | (F.col("left") >= edge), 1).otherwise(0)


def _folded(df: DataFrame, columns: list[str], name: Column, min_iou: float) -> DataFrame:
    """Greedy suppression in the JVM, by (document, island, key) and the gaps within."""
    w = Window.partitionBy("doc_id", "island", "__key").orderBy("left", "right", "box_id")
    cut = df.withColumn("__key", name).withColumn("__cut", gaps(w))
    cut = cut.withColumn("__part", F.sum("__cut").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    size = (F.col("right") - F.col("left")) * (F.col("bottom") - F.col("top"))
    item = F.struct((-F.col("confidence")).alias("c"), (-size).alias("a"), F.col("box_id").alias("id"), F.struct(*columns).alias("box"))
    packed = cut.groupBy("doc_id", "island", "__key", "__part").agg(F.array_sort(F.collect_list(item)).alias("all"))
    start = F.array().cast(packed.schema["all"].dataType)

    def step(kept: Column, x: Column) -> Column:
        return F.when(F.exists(kept, lambda k: struct_iou(k.box, x.box) >= min_iou), kept).otherwise(F.concat(kept, F.array(x)))

    kept = F.when(F.size("all") == 1, F.col("all")).otherwise(F.aggregate("all", start, step))
    return packed.select(F.explode(kept).alias("k")).select("k.box.*")


def struct_iou(a: Column, b: Column) -> Column:
    span = lambda low, high: F.greatest(F.least(a[high], b[high]) - F.greatest(a[low], b[low]), F.lit(0.0))
    own = lambda x: (x["right"] - x["left"]) * (x["bottom"] - x["top"])
    both = span("left", "right") * span("top", "bottom")
    return ratio(both, own(a) + own(b) - both)


# ---- B6, B8: greedy grouping


CHUNK = 256  # boxes whose places are gathered before they join the island's


def _grouped(df: DataFrame, fits, passed, first_fit: bool, name: str, whole_document: bool = False) -> DataFrame:
    """Fold boxes in (top, left) order into groups, all in the JVM.

    fits(group, box) gives the distance of a fitting group, else null; the nearest (or, with
    first_fit, the oldest) fitting group takes the box, else a new one opens. A group is
    (number, top, bottom, sum of centres, sum of heights, count). passed(group, box, tallest)
    holds where neither this box nor a later one, none higher than ``tallest``, can fit: the
    group is closed, so a step looks at the open ones only. Places are gathered by chunks,
    so a long island is not copied at each box. An island whose boxes all have the edges of
    its first one, which then keeps them as a group, is one group without a fold. The boxes
    go along through the fold, so one shuffle by document is all, and nothing is joined.
    """
    marked = df.withColumn("island", F.lit(1)) if whole_document else with_islands(df)
    group_type = "struct<i:int,top:double,bottom:double,centers:double,heights:double,n:int>"

    def grown(g: Column, x: Column) -> Column:
        return F.struct(g.i.alias("i"), F.least(g.top, x.top).alias("top"), F.greatest(g.bottom, x.bottom).alias("bottom"), (g.centers + x.center).alias("centers"), (g.heights + x.height).alias("heights"), (g.n + 1).alias("n"))

    def opened(i: Column, x: Column) -> Column:
        return F.struct(i.alias("i"), x.top.alias("top"), x.bottom.alias("bottom"), x.center.alias("centers"), x.height.alias("heights"), F.lit(1).alias("n"))

    def step(tallest: Column):
        def one(s: Column, x: Column) -> Column:
            able = F.filter(F.transform(s.groups, lambda g: F.struct((F.when(fits(g, x).isNotNull(), 0.0) if first_fit else fits(g, x)).alias("away"), g.i.alias("i"))), lambda c: c.away.isNotNull())
            at = F.coalesce(F.array_min(able).i, s.next)

            def put(at: Column) -> Column:
                left = F.filter(s.groups, lambda g: ~passed(g, x, tallest))
                groups = F.when(at < s.next, F.transform(left, lambda g: F.when(g.i == at, grown(g, x)).otherwise(g))).otherwise(F.concat(left, F.array(opened(at, x))))
                return F.struct(groups.alias("groups"), F.greatest(s.next, at + 1).alias("next"), F.concat(s.placed, F.array(at)).alias("placed"))

            return X.let(at, put)

        return one

    places = F.array().cast("array<int>")
    start = F.struct(F.array().cast(f"array<{group_type}>").alias("groups"), F.lit(0).alias("next"), places.alias("placed"))

    def chunk(s: Column, c: Column) -> Column:
        fresh = F.struct(s.groups.alias("groups"), s.next.alias("next"), places.alias("placed"))
        done = F.aggregate(F.slice("__all", c * CHUNK + 1, F.lit(CHUNK)), fresh, step(F.col("__tallest")))
        return X.let(done, lambda d: F.struct(d.groups.alias("groups"), d.next.alias("next"), F.concat(s.placed, d.placed).alias("placed")))

    item = F.struct(
        *(F.col(c).cast("double").alias(c) for c in ("top", "left")), "box_id", F.col("bottom").cast("double").alias("bottom"), ((F.col("top") + F.col("bottom")) / 2).cast("double").alias("center"),
        F.greatest(F.col("bottom") - F.col("top"), F.lit(1.0)).cast("double").alias("height"), F.struct(*df.columns).alias("box"),
    )
    even = reduce(lambda x, y: x & y, (F.min(c) == F.max(c) for c in ("top", "bottom")))
    packed = marked.groupBy("doc_id", "island").agg(F.collect_list(item).alias("__all"), even.alias("__even"))
    one = F.get("__all", F.lit(0))
    # the edges alone decide whether a box fits the group that it opened
    level = (F.size("__all") == 1) | F.coalesce(F.col("__even") & fits(opened(F.lit(0), one), one).isNotNull(), F.lit(False))
    packed = packed.withColumn("__level", level).withColumn("__all", F.when(F.col("__level"), F.col("__all")).otherwise(F.sort_array("__all")))
    packed = packed.withColumn("__tallest", F.array_max(F.transform(F.when(~F.col("__level"), F.col("__all")), lambda x: x.height)))
    chunks = F.sequence(F.lit(0), F.floor((F.size("__all") - 1) / CHUNK).cast("int"))
    lone = F.struct(F.lit(1).alias("next"), places.alias("placed"))
    fold = X.let(F.aggregate(chunks, start, chunk), lambda s: F.struct(s.next.alias("next"), s.placed.alias("placed")))
    placed = packed.withColumn("__fold", F.when(F.col("__level"), lone).otherwise(fold))
    # each number of an island has a box, so those of the islands before add up
    before = F.sum("__fold.next").over(Window.partitionBy("doc_id").orderBy("island").rowsBetween(Window.unboundedPreceding, -1))
    placed = placed.select("__all", F.col("__fold.placed").alias("__placed"), F.coalesce(before, F.lit(0)).alias("__before"))
    number = lambda i: (F.col("__before") + F.coalesce(F.get("__placed", i), F.lit(0)) + 1).cast("int")
    out = placed.select(F.explode(F.transform("__all", lambda x, i: F.struct(x.box.alias("box"), number(i).alias(name)))).alias("b"))
    return out.select("b.box.doc_id", "b.box.box_id", *(f"b.box.`{c}`" for c in df.columns if c not in ("doc_id", "box_id")), f"b.{name}")


def above(g: Column, x: Column, tallest: Column) -> Column:
    """A group that ends where the box begins or before, and has a height, fits no box from here on."""
    return (g.bottom <= x.top) & (g.top < g.bottom)


def group_lines(df: DataFrame, min_overlap: float = 0.35, max_center: float = 0.80) -> DataFrame:
    """B6. Layout rule: into the line with the nearest centre whose overlap ratio OR centre distance fits.

    max_center must be below 1: then both tests imply vertical overlap and islands are exact.
    """
    if not max_center < 1:
        raise ValueError("max_center must be below 1")

    def fits(g: Column, x: Column) -> Column:
        tall, own = g.bottom - g.top, x.bottom - x.top
        both = F.greatest(F.least(x.bottom, g.bottom) - F.greatest(x.top, g.top), F.lit(0.0))
        away = F.abs((g.top + g.bottom) / 2 - x.center)
        return F.when((ratio(both, F.least(tall, own)) >= min_overlap) | (ratio(away, (tall + own) / 2) <= max_center), away)

    return _grouped(df, fits, above, False, "line_id")


def group_rows(df: DataFrame, tol: float = 0.25, min_overlap: float = 0.45, mode: str = "overlap") -> DataFrame:
    """B8. Merger rule: overlap ratio AND centre distance must fit; the nearest mean centre wins.

    mode="centre" is the earlier rule: the first row whose mean centre is within 0.6 times
    the larger height, over the whole document.
    """

    def overlapping(g: Column, x: Column) -> Column:
        tall = F.greatest(g.bottom - g.top, F.lit(1.0))
        both = F.greatest(F.least(x.bottom, g.bottom) - F.greatest(x.top, g.top), F.lit(0.0))
        close = F.abs(x.center - (g.top + g.bottom) / 2) <= F.greatest(tall, x.height) * tol
        return F.when((both / F.greatest(F.least(x.height, tall), F.lit(1.0)) >= min_overlap) & close, F.abs(x.center - g.centers / g.n))

    def centred(g: Column, x: Column) -> Column:
        away = F.abs(x.center - g.centers / g.n)
        return F.when(away <= 0.6 * F.greatest(g.heights / g.n, x.height), away)

    def behind(g: Column, x: Column, tallest: Column) -> Column:
        # the centre of a box lies half its height below its top, and takes in 0.6 of it
        return x.top - g.centers / g.n > F.greatest(0.6 * g.heights / g.n, 0.1 * tallest) * 1.001

    centre = mode == "centre"
    return _grouped(df, centred if centre else overlapping, behind if centre else above, centre, "row_id", whole_document=centre)


# ---- B7, B9, B10


def joined_text(order: list[Column], sep: str = " ") -> Column:
    """Non-blank texts in order."""
    item = F.struct(*[c.alias(f"k{n}") for n, c in enumerate(order)], F.trim("text").alias("t"))
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.trim("text") != "", item))), lambda s: s.t), sep)


def merge_lines(df: DataFrame, by: str = "line_id") -> DataFrame:
    """B7. One row per group: text left to right, bounds, confidence weighted by area (1 at least), box count."""
    weight = F.greatest((F.col("right") - F.col("left")) * (F.col("bottom") - F.col("top")), F.lit(1.0))
    return df.groupBy("doc_id", by).agg(
        joined_text(order_columns("left")).alias("text"),
        F.min("left").alias("left"), F.min("top").alias("top"), F.max("right").alias("right"), F.max("bottom").alias("bottom"),
        (F.sum(F.col("confidence") * weight) / F.sum(weight)).alias("confidence"), F.count("*").alias("box_count"),
    )


def segment_rows(df: DataFrame, max_gap: float = 1.8, labels: bool = True) -> DataFrame:
    """B9. Adds segment_id (from 1) within a row; labels=False with max_gap 3.5 is the earlier rule.

    A break comes where the gap exceeds max_gap mean heights, where the next box starts a
    field label (unless the previous one holds the local half of a bilingual label), or
    where an expiry-looking box left of x = 330 meets an address-looking one from x = 300.
    Boxes that touch join, except for that column rule.
    """
    w = Window.partitionBy("doc_id", "row_id").orderBy("left", "box_id")
    before = lambda c: F.lag(c).over(w)
    height = F.greatest(F.col("bottom") - F.col("top"), F.lit(1.0))
    gap, mean = F.col("left") - before("right"), (height + before(height)) / 2
    column = (before("left") < 330) & (F.col("left") >= 300) & F.lower(before("text")).rlike(T.EXPIRY_LOOK) & F.lower(F.col("text")).rlike(T.ADDRESS_LOOK)
    label = F.col("text").rlike("(?i)" + T.FIELD_START) & ~before("text").rlike("(?i)" + T.LOCAL_LABEL)
    far = (gap > 0) & ((gap > mean * max_gap) | label if labels else gap > mean * max_gap)
    breaks = F.when(before("box_id").isNotNull() & (column | far if labels else far), 1).otherwise(0)
    marked = df.withColumn("__break", breaks)
    return marked.withColumn("segment_id", 1 + F.sum("__break").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("__break")


def merge_segments(df: DataFrame, normalize: bool = True) -> DataFrame:
    """B10. One row per segment: normalised text, bounds, plain mean confidence rounded to 4, source_count, pos."""
    text = joined_text([F.col("left"), F.col("box_id")])
    out = df.groupBy("doc_id", "row_id", "segment_id").agg(
        (X.normalize_text(text) if normalize else text).alias("text"),
        F.min("left").alias("left"), F.min("top").alias("top"), F.max("right").alias("right"), F.max("bottom").alias("bottom"),
        rounded(F.avg("confidence"), 4).alias("confidence"), F.count("*").alias("source_count"),
    )
    pos = F.row_number().over(Window.partitionBy("doc_id").orderBy("top", "left", "row_id", "segment_id"))
    return out.where("text <> ''").withColumn("pos", pos)


# ---- B11 to B14


def in_vertical_range(df: DataFrame, low: float, high: float) -> DataFrame:
    """B11, inclusive."""
    return df.where(((F.col("top") + F.col("bottom")) / 2).between(low, high))


def in_horizontal_range(df: DataFrame, low: float, high: float) -> DataFrame:
    """B12, inclusive."""
    return df.where(((F.col("left") + F.col("right")) / 2).between(low, high))


def region_table(spark, rows=T.REGIONS) -> DataFrame:
    """Named rectangles; an invalid one raises ValueError."""
    for name, x1, y1, x2, y2 in rows:
        if x2 <= x1 or y2 <= y1:
            raise ValueError(f"region {name} is empty")
    return spark.createDataFrame([(n, *map(float, r)) for n, *r in rows], "region string, x1 double, y1 double, x2 double, y2 double")


def boxes_in_regions(df: DataFrame, regions=T.REGIONS, min_overlap: float = 0.5) -> DataFrame:
    """B13. Boxes joined to each region that covers min_overlap of their area; zero areas are skipped.

    The regions are a Python list of a few rows, so a broadcast range join is safe.
    """
    own = (F.col("right") - F.col("left")) * (F.col("bottom") - F.col("top"))
    across = F.least("right", "x2") - F.greatest("left", "x1")
    down = F.least("bottom", "y2") - F.greatest("top", "y1")
    touch = (F.col("left") < F.col("x2")) & (F.col("right") > F.col("x1")) & (F.col("top") < F.col("y2")) & (F.col("bottom") > F.col("y1")) & (own > 0)
    found = df.join(F.broadcast(region_table(df.sparkSession, regions)), touch)
    return found.where(across * down / own >= min_overlap).drop("x1", "y1", "x2", "y2")


def template_fields(df: DataFrame, pages: DataFrame, regions=T.REGIONS) -> DataFrame:
    """B14. (doc_id, field, value, raw, confidence) from boxes scaled to the template sheet.

    pages(doc_id, page_width, page_height). Texts of a field in reading order, joined by
    ", " for addresses and a space else, then cleaned by the field rules; portrait is no text.
    T.REGIONS_V1 are the regions of the earlier sheet.
    """
    scaled = df.hint("merge").join(pages.hint("merge"), "doc_id")
    x, y = F.lit(float(T.SHEET[0])) / F.col("page_width"), F.lit(float(T.SHEET[1])) / F.col("page_height")
    scaled = scaled.withColumns({"left": F.col("left") * x, "right": F.col("right") * x, "top": F.col("top") * y, "bottom": F.col("bottom") * y})
    hit = boxes_in_regions(scaled, [r for r in regions if r[0] != "portrait"])
    text = F.when(F.col("region").isin("placeOfOrigin", "placeOfResidence"), joined_text(order_columns("reading"), ", ")).otherwise(joined_text(order_columns("reading")))
    out = hit.groupBy("doc_id", "region").agg(text.alias("raw"), rounded(F.avg("confidence"), 4).alias("confidence"))
    # raw texts of a field repeat: frequent ones are cleaned once, the others where they stand
    rows = remembered(stored(out, "raws"), ["region", "raw"], lambda values: values.withColumn("value", clean_field("region", "raw")))
    value = F.when(F.col("__known").isNotNull(), F.col("__known.value")).otherwise(clean_field("region", "raw"))
    return rows.select("doc_id", F.col("region").alias("field"), value.alias("value"), "raw", "confidence")


def clean_field(field: str, value: str) -> Column:
    """The field rule for each row's field name; labels are taken off first."""
    f, out = F.col(field), F.lit(None).cast("string")
    rules = {
        "idNumber": lambda v: X.clean_id(v, "field"), "fullName": lambda v: X.clean_name(v, "field"), "dateOfBirth": lambda v: X.clean_date(v, "field"), "dateOfExpiry": lambda v: X.clean_date(v, "field"),
        "gender": lambda v: X.canon_gender(v, "field"), "nationality": lambda v: X.canon_nationality(v, "field"), "placeOfOrigin": lambda v: X.clean_address(v, "field"), "placeOfResidence": lambda v: X.clean_address(v, "field"),
    }
    for name, rule in rules.items():
        out = F.when(f == name, rule(X.strip_labels(F.col(value), name))).otherwise(out)
    return out


# ---- B15 to B18


STRIP = 400.0  # width of a strip of boxes


MANY = 500  # boxes of a document from which on it is cut into cells


def met(a: DataFrame, b: DataFrame, by: tuple[str, ...], on: list[Column], x: tuple[Column, Column] | None = None, y: tuple[Column, Column] | None = None, flat: bool = False) -> DataFrame:
    """Pairs as structs (a, b): rows with equal ``by`` that pass ``on``, a condition on a.* and b.*.

    x and y say how far at most the rows of a pair reach out for each other on an axis,
    each by a column of its own row: no pair passes whose boxes, widened by that, do not
    touch. Documents of more than MANY boxes are then dealt into cells, about as large as
    their boxes, and only rows in one cell are compared, so that the work grows with the
    boxes and not with their square. A pair counts in the first cell that both rows have.
    flat: of boxes without a height, which have no measure to reach by, any two may pass.
    """

    def plain(p: DataFrame, q: DataFrame, more: list[Column]) -> DataFrame:
        joined = p.alias("a").hint("merge").join(q.alias("b").hint("merge"), [*(F.col(f"a.{c}") == F.col(f"b.{c}") for c in by), *more, *on])
        return joined.select(F.struct(*(f"a.{c}" for c in a.columns)).alias("a"), F.struct(*(f"b.{c}" for c in b.columns)).alias("b"))

    reach = {axis: pair for axis, pair in (("x", x), ("y", y)) if pair is not None}
    edges = {"x": ("left", "right"), "y": ("top", "bottom")}
    if not reach:
        return plain(a, b, [])
    cells = [F.greatest(2 * F.avg(F.col(high) - F.col(low) + 2 * reach[k][1]), (F.max(high) - F.min(low)) / F.sqrt(F.count("*")), F.lit(1e-6)).alias(f"__{k}") for k, (low, high) in edges.items() if k in reach]
    crowded = stored(b.groupBy(*by).agg(F.count("*").alias("__n"), *cells).where(F.col("__n") > MANY).drop("__n"), "crowded")
    few = crowded.count()
    if not few:
        return plain(a, b, [])
    known = F.broadcast(crowded) if few <= FEW_VALUES else crowded.hint("merge")

    def dealt(df: DataFrame, side: int) -> DataFrame:
        out = df.join(known, list(by))
        for k, (low, high) in edges.items():
            if k in reach:
                wider = reach[k][side] * (1 + 1e-6) + 1e-6
                first, last = F.floor((F.col(low) - wider) / F.col(f"__{k}")), F.floor((F.col(high) + wider) / F.col(f"__{k}"))
                out = out.withColumn(f"__{k}0", first).withColumn(f"__{k}", F.explode(F.sequence(first, last)))
        return out

    once = [c for k in reach for c in (F.col(f"a.__{k}") == F.col(f"b.__{k}"), F.col(f"a.__{k}") == F.greatest(f"a.__{k}0", f"b.__{k}0"))]
    parts = [plain(a.join(known, list(by), "left_anti"), b.join(known, list(by), "left_anti"), []), plain(dealt(a, 0), dealt(b, 1), once)]
    if flat:
        no_height = F.col("bottom") <= F.col("top")
        parts[1] = parts[1].where("NOT (a.bottom <= a.top AND b.bottom <= b.top)")
        parts.append(plain(a.join(known, list(by), "left_semi").where(no_height), b.join(known, list(by), "left_semi").where(no_height), []))
    return reduce(DataFrame.unionByName, parts)


def _pairs(df: DataFrame, by: tuple[str, ...], condition, within: float | None = None, x=None, y=None, flat: bool = False) -> DataFrame:
    """Ordered pairs (a, b); with ``within`` those with a horizontal gap up to it, all of them. x, y and flat as for ``met``."""
    on = [F.col("a.box_id") != F.col("b.box_id"), *([condition] if condition is not None else [])]
    if within is None:
        return met(df, df, by, on, x, y, flat)

    # dealt into strips, b to each strip it touches, a to each one it touches when widened by the gap; the boxes of a
    # strip then meet in one row, so rows that lie by ``by`` already are not moved and nothing is joined
    strip = lambda edge: F.floor(edge / STRIP)
    places = {"__first": strip(F.col("left") - within), "__from": strip(F.col("left")), "__to": strip(F.col("right"))}
    slim = df.select(*dict.fromkeys((*by, "box_id", *EDGES))).withColumns(places).withColumn("__strip", F.explode(F.sequence("__first", strip(F.col("right") + within))))
    item = F.struct(*(c for c in slim.columns if c != "__strip"))
    whole = slim.groupBy(*by, "__strip").agg(F.collect_list(item).alias("__all"))
    held = whole.withColumn("__held", F.filter("__all", lambda x: F.col("__strip").between(x["__from"], x["__to"]))).where(F.size("__held") > 0)
    both = held.select("__strip", "__held", F.explode("__all").alias("a")).select("__strip", "a", F.explode("__held").alias("b"))
    once = F.col("__strip") == F.greatest("a.__first", "b.__from")
    return both.where(reduce(lambda x, y: x & y, [*on, once, gap("a", "b", "left", "right") <= within])).select("a", "b")


def gap(a: str, b: str, low: str, high: str) -> Column:
    return F.greatest(F.col(f"{b}.{low}") - F.col(f"{a}.{high}"), F.col(f"{a}.{low}") - F.col(f"{b}.{high}"), F.lit(0.0))


def height(a: str) -> Column:
    return F.col(f"{a}.bottom") - F.col(f"{a}.top")


def width(a: str) -> Column:
    return F.col(f"{a}.right") - F.col(f"{a}.left")


def center(a: str, low: str, high: str) -> Column:
    return (F.col(f"{a}.{low}") + F.col(f"{a}.{high}")) / 2


def overlap_ratio(a: str, b: str, low: str, high: str, relative_to: str = "minimum") -> Column:
    span = lambda s: F.col(f"{s}.{high}") - F.col(f"{s}.{low}")
    base = {"first": span(a), "second": span(b), "minimum": F.least(span(a), span(b)), "union": F.greatest(F.col(f"{a}.{high}"), F.col(f"{b}.{high}")) - F.least(F.col(f"{a}.{low}"), F.col(f"{b}.{low}"))}[relative_to]
    return ratio(overlap(a, b, low, high), base)


def pair_metrics(df: DataFrame, by: tuple[str, ...] = ("doc_id",), relative_to: str = "minimum", within: float | None = None) -> DataFrame:
    """B15. Ordered pairs within ``by`` with overlaps, ratios, gaps, centre distance, intersection and IoU.

    Give a second key (line, island) where documents are long: pairs grow with its square.
    ``within`` keeps pairs with a horizontal gap up to it, so that long lines cost no square.
    """
    mean = (height("a") + height("b")) / 2
    both = overlap("a", "b", "left", "right") * overlap("a", "b", "top", "bottom")
    dx, dy = center("a", "left", "right") - center("b", "left", "right"), center("a", "top", "bottom") - center("b", "top", "bottom")
    return _pairs(df, by, None, within).select(
        *(F.col(f"a.{c}") for c in by), F.col("a.box_id").alias("a"), F.col("b.box_id").alias("b"),
        overlap("a", "b", "left", "right").alias("x_overlap"), overlap("a", "b", "top", "bottom").alias("y_overlap"),
        overlap_ratio("a", "b", "left", "right", relative_to).alias("x_ratio"), overlap_ratio("a", "b", "top", "bottom", relative_to).alias("y_ratio"),
        gap("a", "b", "left", "right").alias("x_gap"), gap("a", "b", "top", "bottom").alias("y_gap"),
        F.sqrt(dx * dx + dy * dy).alias("distance"), both.alias("intersection"), iou("a", "b").alias("iou"),
        ratio(gap("a", "b", "left", "right"), mean).alias("x_gap_ratio"), ratio(gap("a", "b", "top", "bottom"), mean).alias("y_gap_ratio"),
    )


def same_line(a: str, b: str, min_overlap: float = 0.45, max_center: float = 0.65) -> Column:
    away = F.abs(center(a, "top", "bottom") - center(b, "top", "bottom"))
    return (overlap_ratio(a, b, "top", "bottom") >= min_overlap) | (ratio(away, (height(a) + height(b)) / 2) <= max_center)


def right_of(c: str, a: str, strict: bool = False) -> Column:
    beyond = F.col(f"{c}.left") >= F.col(f"{a}.right") if strict else center(c, "left", "right") > center(a, "left", "right")
    return beyond & ((overlap_ratio(c, a, "top", "bottom") >= 0.30) | same_line(c, a))


def below(c: str, a: str, strict: bool = False) -> Column:
    beyond = F.col(f"{c}.top") >= F.col(f"{a}.bottom") if strict else center(c, "top", "bottom") > center(a, "top", "bottom")
    return beyond & (overlap_ratio(c, a, "left", "right") >= 0.20)


def relate(df: DataFrame, kind: str, strict: bool = False, by: tuple[str, ...] = ("doc_id",), within: float | None = None) -> DataFrame:
    """B16. Pairs (box, other) where other lies right_of, left_of, below, above or on the same_line of box.

    ``within`` as for ``pair_metrics``.
    """
    test = {"right_of": lambda: right_of("b", "a", strict), "left_of": lambda: right_of("a", "b", strict), "below": lambda: below("b", "a", strict), "above": lambda: below("a", "b", strict), "same_line": lambda: same_line("a", "b")}
    if kind not in test:
        raise ValueError(f"unknown relation {kind!r}")
    touch = (F.lit(0.0), F.lit(0.0))  # boxes on one line touch in y, those below each other in x
    axes = {"x": touch} if kind in ("below", "above") else {"y": touch, "flat": True}
    return _pairs(df, by, test[kind](), within, **axes).select(*(F.col(f"a.{c}") for c in by), F.col("a.box_id").alias("box"), F.col("b.box_id").alias("other"))


def contains_point(df: DataFrame, points: DataFrame) -> DataFrame:
    """B17. points(doc_id, point_id, x, y) in boxes, all edges inclusive."""
    spots = points.select("doc_id", "point_id", *(F.col("x").alias(c) for c in ("left", "right")), *(F.col("y").alias(c) for c in ("top", "bottom")))
    on = F.col("a.left").between(F.col("b.left"), F.col("b.right")) & F.col("a.top").between(F.col("b.top"), F.col("b.bottom"))
    touch = (F.lit(0.0), F.lit(0.0))
    return met(spots, df, ("doc_id",), [on], touch, touch).select("b.doc_id", "b.box_id", "a.point_id")


def contains_box(df: DataFrame, tolerance: float = 0.0, by: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """B17. Pairs (outer, inner) within the tolerance, all edges inclusive."""
    inside = (F.col("b.left") >= F.col("a.left") - tolerance) & (F.col("b.right") <= F.col("a.right") + tolerance) & (F.col("b.top") >= F.col("a.top") - tolerance) & (F.col("b.bottom") <= F.col("a.bottom") + tolerance)
    reach = (F.lit(tolerance), F.lit(0.0))
    return _pairs(df, by, inside, x=reach, y=reach).select(*(F.col(f"a.{c}") for c in by), F.col("a.box_id").alias("outer"), F.col("b.box_id").alias("inner"))


def prepare_boxes(df: DataFrame, min_conf: float = 0.05, dedupe: bool = True, merge: bool = False) -> DataFrame:
    """B18. Normalise (where corners are given), filter, suppress duplicates, merge lines, reading order."""
    out = normalize_boxes(df).drop("width", "height", "area", "center_x", "center_y") if "corners" in df.columns else df
    out = filter_min_size(filter_confidence(out, min_conf))
    out = suppress_duplicates(out) if dedupe else out
    if merge:
        out = merge_lines(group_lines(out)).withColumnRenamed("line_id", "box_id")
    return order_boxes(out)
