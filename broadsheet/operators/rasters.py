"""Label planes as rows (page, y, x, label) and as binary tiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.dims import SEPARATOR_LABELS, class_of, weight_of
from ..functions.numbers import ratio, steady


def remapped(plane: DataFrame) -> DataFrame:
    """Labels to class indexes by a literal table: no join, no shuffle."""
    return plane.withColumn("cls", class_of(F.col("label")))


def masked(plane: DataFrame, labels: tuple[int, ...], outside: int = 0) -> DataFrame:
    return plane.withColumn("label", F.when(F.col("label").isin(*labels), F.col("label")).otherwise(outside))


def one_hot(plane: DataFrame, classes: tuple[int, ...]) -> DataFrame:
    """A column ``mask`` with one number for each class of a mask whose values are class + 1; with several classes the background, what is left of 1, comes last."""
    marks = [(F.col("label") == c + 1).cast("double") for c in classes]
    rest = [F.lit(1.0) - sum(marks[1:], marks[0])] if len(marks) > 1 else []
    return plane.withColumn("mask", F.array(*marks, *rest))


def without_separators(plane: DataFrame) -> DataFrame:
    return plane.withColumn("label", F.when(F.col("label").isin(*SEPARATOR_LABELS), 0).otherwise(F.col("label")))


def resampled(plane: DataFrame, fx: int, fy: int) -> DataFrame:
    """Each target cell gets the present label of most weight; ties go to the lowest code."""
    cell = plane.withColumns({"ty": F.floor(F.col("y") / fy).cast("int"), "tx": F.floor(F.col("x") / fx).cast("int")})
    win = F.max_by("label", F.struct(weight_of(F.col("label")), -F.col("label")))
    return cell.groupBy("page", "ty", "tx").agg(win.alias("label"))


def any_foreground(plane: DataFrame, f: int) -> DataFrame:
    """A target cell is foreground if any pixel in it is."""
    return plane.groupBy("page", F.floor(F.col("y") / f).cast("int").alias("ty"), F.floor(F.col("x") / f).cast("int").alias("tx")).agg(F.max((F.col("label") > 0).cast("int")).alias("fg"))


def majority(votes: DataFrame, keys: list[str], undecided: int = 0) -> DataFrame:
    """The label with most votes; a tie for the top is undecided."""
    counts = votes.groupBy(*keys, "label").agg(F.count(F.lit(1)).alias("c"))
    tops = counts.groupBy(*keys).agg(F.max("c").alias("top"), F.max_by("label", F.struct("c", -F.col("label"))).alias("label"), F.collect_list("c").alias("cs"))
    tied = F.size(F.filter("cs", lambda c: c == F.col("top"))) > 1
    return tops.select(*keys, F.when(tied, F.lit(undecided)).otherwise(F.col("label")).alias("label"), F.col("top").alias("votes"))


def shares(rows: DataFrame, page: str, label: str, classes: list) -> DataFrame:
    """Share of every class on every page, absent ones 0: a pivot-free zero fill from one conditional aggregation."""
    total = F.count(F.lit(1))
    wide = rows.groupBy(page).agg(*[(F.count_if(F.col(label) == c) / total).alias(f"c{i}") for i, c in enumerate(classes)])
    cells = F.array(*[F.struct(F.lit(c).alias("cls"), F.col(f"c{i}").alias("share")) for i, c in enumerate(classes)])
    return wide.select(page, F.explode(cells).alias("s")).select(page, "s.cls", steady(F.col("s.share")).alias("share"))


def class_weights(shared: DataFrame, n_pixels: int, buckets: int = 4096) -> DataFrame:
    """n_pixels over the median of the shares that aren't 0; 0 for a class never seen.

    Counts by bucket of the share find the one or two buckets of each class that hold its middle; only
    their values are counted and ranked.
    """
    seen = shared.filter("share > 0").withColumn("b", F.floor(F.col("share") * buckets))
    sizes = seen.groupBy("cls", "b").agg(F.count(F.lit(1)).alias("n"))
    upto = Window.partitionBy("cls").orderBy("b")
    total = F.sum("n").over(Window.partitionBy("cls"))
    placed = sizes.withColumns({"end": F.sum("n").over(upto), "lo": F.floor((total + 1) / 2), "hi": F.floor((total + 2) / 2)})  # ranks from 1
    placed = placed.withColumn("start", F.col("end") - F.col("n")).filter((F.col("start") < F.col("hi")) & (F.col("end") >= F.col("lo"))).select("cls", "b", "start", "lo", "hi")
    values = seen.join(placed, ["cls", "b"]).groupBy("cls", "b", "start", "lo", "hi", "share").agg(F.count(F.lit(1)).alias("n"))
    ranked = values.withColumn("end", F.col("start") + F.sum("n").over(Window.partitionBy("cls", "b").orderBy("share")))
    holds = lambda r: F.min(F.when((F.col("end") - F.col("n") < F.col(r)) & (F.col("end") >= F.col(r)), F.col("share")))
    middle = ranked.groupBy("cls").agg(((holds("lo") + holds("hi")) / 2).alias("middle"))
    return shared.select("cls").distinct().join(middle, "cls", "left").select("cls", steady(F.coalesce(F.try_divide(F.lit(float(n_pixels)), F.col("middle")), F.lit(0.0)), 6).alias("weight"))


def background_weight(weights: DataFrame, selected: list) -> DataFrame:
    """Selected classes keep their weight, the others become one background: 1 / sum(1 / w)."""
    rest = F.sum(F.when(~F.col("cls").isin(*selected), F.try_divide(F.lit(1.0), F.col("weight"))))
    background = weights.agg(F.lit("background").alias("cls"), steady(F.try_divide(F.lit(1.0), rest), 6).alias("weight"))
    return weights.filter(F.col("cls").isin(*selected)).unionByName(background)


def nearest_colour(pixels: DataFrame, palette: list[tuple[int, tuple[int, int, int]]]) -> DataFrame:
    """(r, g, b) to the nearest palette code; background where all three channels differ from it."""
    far = lambda rgb: sum(((F.col(c) - F.lit(v)) * (F.col(c) - F.lit(v)) for c, v in zip("rgb", rgb, strict=True)), F.lit(0))
    best = F.array_min(F.array(*[F.struct(far(rgb).alias("d"), F.lit(code).alias("code"), *[F.lit(v).alias(f"p{c}") for c, v in zip("rgb", rgb, strict=True)]) for code, rgb in palette]))
    found = pixels.withColumn("best", best)
    off = (F.col("r") != F.col("best.pr")) & (F.col("g") != F.col("best.pg")) & (F.col("b") != F.col("best.pb"))
    return found.withColumns({"label": F.col("best.code"), "ignored": off}).withColumn("label", F.when(F.col("ignored"), 0).otherwise(F.col("label"))).drop("best")


def overlaid(layers: list[DataFrame]) -> DataFrame:
    """Planes (page, y, x, label) laid over each other; the last in the list is on top."""
    rows = layers[0].withColumn("z", F.lit(0))
    for z, layer in enumerate(layers[1:], 1):
        rows = rows.unionByName(layer.withColumn("z", F.lit(z)))
    return rows.groupBy("page", "y", "x").agg(F.max_by("label", F.struct("z", F.col("label"))).alias("label"))


def stitched(pixels: DataFrame, tiles: DataFrame) -> DataFrame:
    """Only the pixels in a tile's inner part; ``tiles`` is a tiling and has a handful of rows."""
    return pixels.join(F.broadcast(tiles), (pixels["x"] >= tiles["inner0"]) & (pixels["x"] < tiles["inner1"]))


def subtracted(mask: DataFrame, other: DataFrame) -> DataFrame:
    return mask.join(other, ["page", "y", "x"], "left_anti")


def dilated(mask: DataFrame, half_x: int, half_y: int) -> DataFrame:
    """Foreground cells (page, y, x) grown by a box."""
    box = F.array(*[F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx")) for dy in range(-half_y, half_y + 1) for dx in range(-half_x, half_x + 1)])
    grown = mask.select("page", "y", "x", F.explode(box).alias("d"))
    return grown.select("page", (F.col("y") + F.col("d.dy")).alias("y"), (F.col("x") + F.col("d.dx")).alias("x")).distinct()


def eroded(mask: DataFrame, half_x: int, half_y: int) -> DataFrame:
    """Cells whose whole box is foreground."""
    full = (2 * half_x + 1) * (2 * half_y + 1)
    box = F.array(*[F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx")) for dy in range(-half_y, half_y + 1) for dx in range(-half_x, half_x + 1)])
    votes = mask.distinct().select(F.col("page"), F.col("y"), F.col("x"), F.explode(box).alias("d"))
    votes = votes.select("page", (F.col("y") + F.col("d.dy")).alias("y"), (F.col("x") + F.col("d.dx")).alias("x"))
    return votes.groupBy("page", "y", "x").count().filter(F.col("count") == full).drop("count")


def closed(mask: DataFrame, half_x: int, half_y: int) -> DataFrame:
    return eroded(dilated(mask, half_x, half_y), half_x, half_y)


def modal(rows: DataFrame, key: str, ignore: int | None = None, double: tuple[int, ...] = ()) -> DataFrame:
    """The most frequent label of each key, lowest code first; some labels count double and one not at all. A key that holds only this one is background (0)."""
    counts = rows.groupBy(key, "label").agg(F.count(F.lit(1)).alias("c"))
    weight = F.when(F.col("label") == ignore, 0).when(F.col("label").isin(*double), 2).otherwise(1)
    best = counts.withColumn("c", F.col("c") * weight).groupBy(key).agg(F.max(F.struct(F.col("c"), (-F.col("label")).alias("low"))).alias("b"))
    return best.select(key, F.when(F.col("b.c") > 0, -F.col("b.low")).otherwise(F.lit(0)).alias("label"))


def label_ratio(rows: DataFrame, key: str) -> DataFrame:
    """Normalised label histogram by key."""
    counts = rows.groupBy(key, "label").agg(F.count(F.lit(1)).alias("c"))
    return counts.withColumn("ratio", steady(ratio(F.col("c"), F.sum("c").over(Window.partitionBy(key)))))


def corridor_free(hist: DataFrame, key: str, own: int, ignore: tuple[int, ...] = ()) -> DataFrame:
    """Keys whose histogram (label, ratio) lets two segments of label ``own`` be joined.

    Background, border, the own label and ``ignore`` never matter. Table text doesn't matter to table columns and
    horizontal lines, and small antiqua not to vertical lines, while there is less of it than of the own label.
    """
    rival = {7: 5, 8: 5, 9: 4}.get(own, -1)
    total = lambda which: F.coalesce(F.sum(F.when(which & ~F.col("label").isin(*ignore, -1), F.col("ratio"))), F.lit(0.0))
    rest = total(~F.col("label").isin(0, 6, own, rival))
    mine, other = total(F.col("label") == own), total(F.col("label") == rival)
    return hist.groupBy(key).agg(((rest == 0) & ((other == 0) | (mine > other))).alias("free"))
