"""Layout features of pages from a table of their text boxes: margins, type sizes, columns, bands, title and leading.

Boxes: key, x0, y0, x1, y1, size and text, with the origin at the lower left. Everything is grouped by page; the second pass
is needed as what counts as large type, and as a gap between lines, depends on a page's median size.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Where a left and a right column start (shares of the width), how many starts make two columns and their least
#: ratio, head and foot bands (shares of the height), how large a title is, the widest gap between lines, leading without one.
LEFT, RIGHT_FROM, RIGHT_TO = 0.45, 0.5, 0.9
STARTS, START_RATIO = 6, 0.25
HEAD, FOOT = 0.92, 0.08
TITLE_SIZE, WIDEST_GAP, NO_LEADING = 1.35, 5, 1.2


def layout_features(boxes: DataFrame, key: str, width: float, height: float) -> DataFrame:
    """One row of features for each page that has a box; lengths are shares of the page's width or height."""
    c = F.col
    right = (c("x0") > width * RIGHT_FROM) & (c("x0") < width * RIGHT_TO)
    left = c("x0") < width * LEFT
    page = boxes.groupBy(key).agg(
        F.min("x0").alias("x_min"), F.max("x1").alias("x_max"), F.max("y1").alias("y_max"), F.min("y0").alias("y_min"),
        F.median("size").alias("med"), (F.percentile("size", 0.9) - F.percentile("size", 0.1)).alias("spread"),
        F.count_if(left).alias("n_left"), F.count_if(right).alias("n_right"), F.median(F.when(right, c("x0"))).alias("mode"), F.percentile(F.when(left, c("x1")), 0.9).alias("edge"),
        F.avg((c("y1") > height * HEAD).cast("double")).alias("hdr_band"), F.avg((c("y0") < height * FOOT).cast("double")).alias("ftr_band"), F.sum(F.length("text")).alias("chars"),
    )
    sized = boxes.join(page.select(key, "med"), key)
    down = Window.partitionBy(key).orderBy(F.desc("y1"), "x0")
    gap = c("y1") - F.lead("y1").over(down)
    sized = sized.withColumn("gap", F.when((gap > 0) & (gap < WIDEST_GAP * c("med")), gap))
    large = F.when(c("size") >= TITLE_SIZE * c("med"), F.struct("y1", (-c("x0")).alias("nx"), "size", "x1"))
    second = sized.groupBy(key).agg(F.max(large).alias("big"), F.median("gap").alias("gap"))
    two = (c("n_right") > STARTS) & (c("n_left") > STARTS) & (c("n_right") / F.greatest(c("n_left"), F.lit(1)) > START_RATIO)
    has = c("big").isNotNull()
    shares = {
        "margin_l": (c("x_min") / width, 4), "margin_r": (1 - c("x_max") / width, 4), "margin_t": (1 - c("y_max") / height, 4), "margin_b": (c("y_min") / height, 4),
        "med_fontsize": (c("med"), 2), "font_spread": (c("spread") / F.greatest(c("med"), F.lit(1.0)), 3),
        "gutter_center": (F.when(two, (c("edge") + c("mode")) / 2 / width).otherwise(0.0), 4), "gutter_w": (F.when(two, F.greatest(F.lit(0.0), c("mode") - c("edge")) / width).otherwise(0.0), 4),
        "col_w": (F.when(two, (c("mode") - c("x_min")) / width).otherwise((c("x_max") - c("x_min")) / width), 4), "hdr_band": (c("hdr_band"), 3), "ftr_band": (c("ftr_band"), 3),
        "title_y": (F.when(has, 1 - c("big.y1") / height).otherwise(1 - c("y_max") / height), 4), "title_ratio": (F.when(has, c("big.size") / c("med")).otherwise(1.0), 3),
        "title_cx": (F.when(has, (c("big.x1") - c("big.nx")) / 2 / width).otherwise((c("x_min") + c("x_max")) / 2 / width), 3),
        "leading": (F.coalesce(c("gap") / c("med"), F.lit(NO_LEADING)), 3), "txt_density": (c("chars") / (width * height) * 1000, 3),
    }
    return page.join(second, key).select(key, F.when(two, 2).otherwise(1).alias("n_cols"), *[F.round(x, n).alias(name) for name, (x, n) in shares.items()])
