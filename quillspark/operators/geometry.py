"""Page geometry: overlap, region classification, clustering on a line, reading order, typed or handwritten."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .groups import over_groups
from .spread import parts, spread


def iou(ax, ay, aw, ah, bx, by, bw, bh) -> Column:
    """Intersection over union of two boxes (x, y, w, h); 0 where the union is empty."""
    w = F.greatest(F.lit(0), F.least(ax + aw, bx + bw) - F.greatest(ax, bx))
    h = F.greatest(F.lit(0), F.least(ay + ah, by + bh) - F.greatest(ay, by))
    both = w * h
    union = aw * ah + bw * bh - both
    return F.when(union <= 0, F.lit(0.0)).otherwise(both / union)


def clusters(frame: DataFrame, keys: list[str], value: str, tolerance: Column | float, name: str) -> DataFrame:
    """Islands on a line: sorted by value, a new cluster begins where the gap exceeds the tolerance; numbered from 0."""
    tolerance = F.lit(tolerance) if isinstance(tolerance, (int, float)) else tolerance
    order = Window.partitionBy(*keys).orderBy(value)
    gap = F.when(F.col(value) - F.lag(value).over(order) > tolerance, 1).otherwise(0)
    return frame.withColumn("_gap", gap).withColumn(name, F.sum("_gap").over(order.rowsBetween(Window.unboundedPreceding, 0)).cast("long")).drop("_gap")


def components_in_boxes(boxes: DataFrame, components: DataFrame) -> DataFrame:
    """(page, box, component): centroid inside the box, edges included; a component may lie in several boxes."""
    inside = F.col("cx").between(F.col("x"), F.col("x") + F.col("w")) & F.col("cy").between(F.col("y"), F.col("y") + F.col("h"))
    c = components.select("page_id", "comp_id", "cx", "cy", F.col("w").alias("cw"), F.col("h").alias("ch"), "area")
    boxes, c = spread(parts(boxes, c), "page_id", boxes, c)
    return boxes.join(c, "page_id").where(inside)


# Classification thresholds (shares of the box, the grid or the page; counts; confidences).
STAMP = {"fill": 0.35, "aspect": 0.6, "size": 0.25, "components": 3, "confidence": 0.85}
TABLE = {"rows": 3, "cols": 2, "fill": 0.6, "tolerance": 0.6, "confidence": 0.8}
SIGNATURE = {"height": 0.12, "width": 0.5, "zone": 0.25, "confidence": 0.6}
MARGIN = {"zone": 0.12, "area": 0.05, "confidence": 0.6}
PARAGRAPH_CONFIDENCE = 0.5


def classify_regions(boxes: DataFrame, components: DataFrame, page_w: int = 1000, page_h: int = 1400) -> DataFrame:
    """Region type and confidence of each box that holds a component, by the first rule that fits: a dense, square,
    compact mark is a stamp; a filled grid of components is a table; a small box low on the page is a signature; a small box in the
    outer margin is an annotation; anything else is a paragraph. One shuffle by page and box serves both grid axes' sums."""
    keys = ["page_id", "box_id"]
    held = components_in_boxes(boxes, components).drop("comp_id", "cw")  # three sorts follow
    held = held.withColumn("_tol", F.greatest(F.avg("ch").over(Window.partitionBy(*keys)) * TABLE["tolerance"], F.lit(1.0)))
    held = clusters(held, keys, "cy", F.col("_tol"), "row")
    held = clusters(held, keys, "cx", F.col("_tol"), "col")
    seen = held.groupBy(*keys, "x", "y", "w", "h").agg(
        F.count("*").cast("long").alias("n"), F.sum("area").cast("double").alias("ink"), (F.max("row") + 1).alias("n_rows"), (F.max("col") + 1).alias("n_cols"),
    )
    area, right = F.col("w") * F.col("h"), F.col("x") + F.col("w")
    rules = [
        ("stamp", STAMP, (F.col("ink") / area >= STAMP["fill"]) & (F.abs(F.col("w") / F.col("h") - 1.0) <= STAMP["aspect"]) & (F.col("w") <= page_w * STAMP["size"])
         & (F.col("h") <= page_h * STAMP["size"]) & (F.col("n") <= STAMP["components"])),
        ("table", TABLE, (F.col("n_rows") >= TABLE["rows"]) & (F.col("n_cols") >= TABLE["cols"]) & (F.col("n") >= TABLE["rows"] * TABLE["cols"])
         & (F.col("n") >= F.col("n_rows") * F.col("n_cols") * TABLE["fill"])),
        ("signature", SIGNATURE, (F.col("y") >= page_h * (1 - SIGNATURE["zone"])) & (F.col("h") <= page_h * SIGNATURE["height"]) & (F.col("w") <= page_w * SIGNATURE["width"])),
        ("margin_annotation", MARGIN, ((right <= page_w * MARGIN["zone"]) | (F.col("x") >= page_w * (1 - MARGIN["zone"]))) & (area <= page_w * page_h * MARGIN["area"])),
    ]
    kind, sure = F.lit("paragraph"), F.lit(PARAGRAPH_CONFIDENCE)
    for name, values, rule in reversed(rules):
        kind, sure = F.when(rule, name).otherwise(kind), F.when(rule, values["confidence"]).otherwise(sure)
    return seen.select(*keys, "n", "n_rows", "n_cols", kind.alias("region_type"), sure.alias("confidence"))


def typed_or_handwritten(components: DataFrame, page_area: int, least: int = 4, spread: float = 0.5) -> DataFrame:
    """typed, or handwritten where the heights of the components (4 pixels to half the page) vary a lot."""
    fit = components.where((F.col("area") >= 4) & (F.col("area") <= 0.5 * page_area))
    seen = fit.groupBy("page_id").agg(F.count("*").cast("long").alias("n"), (F.stddev_pop("h") / F.avg("h")).alias("spread"))
    return seen.select("page_id", "n", "spread", F.when((F.col("n") >= least) & (F.col("spread") > spread), "handwritten").otherwise("typed").alias("hand"))


def reading_order(boxes: DataFrame, keep: float = 0.5) -> DataFrame:
    """Reading order of the boxes of each page. Boxes are taken from the top; each joins the first visual row that it
    overlaps by more than `keep` of the lower height, and widens it; rows follow in order of creation, boxes from left to right."""

    def order(bounds: list[int], boxes: dict[str, list]) -> tuple[list[int], list[int]]:
        x, y, h, box_id = (boxes[c] for c in ("x", "y", "h", "box_id"))
        place, number = [], []
        for first, last in zip(bounds, bounds[1:]):
            rows: list[list] = []  # top, bottom, members
            for i in range(first, last):
                top, bottom = y[i], y[i] + h[i]
                for row in rows:
                    shared = min(bottom, row[1]) - max(top, row[0])
                    if shared > keep * min(h[i], row[1] - row[0]):
                        row[0], row[1] = min(row[0], top), max(row[1], bottom)
                        row[2].append(i)
                        break
                else:
                    rows.append([top, bottom, [i]])
            for row in rows:
                place += sorted(row[2], key=lambda i: (x[i], box_id[i]))
            number += range(last - first)
        return place, number

    # A missing number sorts last and overlaps nothing.
    number = lambda c: F.coalesce(F.col(c).cast("double"), F.lit(float("nan")))
    keys = {"y": number("y"), "x": number("x"), "box_id": F.col("box_id").cast("long"), "h": number("h")}
    return over_groups(boxes.withColumn("page_id", F.col("page_id").cast("string")), "page_id", keys, [], order, ["x", "y", "h", "box_id"], ["box_id"], "page_id string, box_id long, reading_order long")


def pdf_scale(width: Column, height: Column, dpi: float = 300.0, most: int = 40_000_000) -> Column:
    """Scale from points to pixels: the resolution asked for, or the largest that stays within the pixel limit."""
    wanted = F.lit(dpi / 72.0)
    area = width * height
    return F.when(area * wanted * wanted > most, F.sqrt(F.lit(float(most)) / area)).otherwise(wanted)


def quality(sharpness: Column, contrast: Column) -> Column:
    """Mean of clipped sharpness and contrast, 4 places."""
    return F.round((F.least(sharpness / 500, F.lit(1.0)) + F.least(contrast / 80, F.lit(1.0))) / 2, 4)
