"""One-dimensional tilings as array expressions; a page's tiles are the product of both axes.

Three rules exist and differ on purpose: training wants an overlap of 50 from two
tiles up, evaluation starts from ceil(full / tile) tiles, prediction rounds half to even.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MIN_OVERLAP = 50


def _first_count(full: Column, tile: Column, least: Column, strict: bool) -> Column:
    """The smallest number of tiles whose overlap suffices; the range ends where it must."""
    most = least + F.ceil(F.try_divide((full - tile).cast("double"), (tile - MIN_OVERLAP).cast("double"))) + 2
    spare = lambda n: tile - (full - tile) / (n - 1)
    enough = (lambda n: spare(n) > MIN_OVERLAP) if strict else (lambda n: (spare(n)).cast("int") >= MIN_OVERLAP)
    return F.filter(F.sequence(least.cast("int"), most.cast("int")), enough)[0]


def _clamped(x: Column, full: Column, tile: Column) -> Column:
    return (x - F.greatest(F.lit(0), x + tile - full)).cast("int")


def starts_cut(full: Column, tile: Column, n: Column) -> Column:
    """Even steps with the overlap cut to a whole number; the last tile is clamped."""
    step = tile - ((n * tile - full) / (n - 1)).cast("int")
    return F.transform(F.sequence(F.lit(0), n - 1), lambda i: _clamped(i * step, full, tile))


def starts_rounded(full: Column, tile: Column, n: Column) -> Column:
    """Positions rounded half to even."""
    return F.transform(F.sequence(F.lit(0), n - 1), lambda i: _clamped(F.rint(i * tile * ((full - tile) / ((n - 1) * tile))).cast("int"), full, tile))


def train_starts(full: Column, tile: Column) -> Column:
    return F.when(full == tile, F.array(F.lit(0))).otherwise(starts_cut(full, tile, _first_count(full, tile, F.lit(2), strict=False)))


def eval_starts(full: Column, tile: Column) -> Column:
    return F.when(full == tile, F.array(F.lit(0))).otherwise(starts_cut(full, tile, _first_count(full, tile, F.greatest(F.lit(2), F.ceil(full / tile)), strict=True)))


def predict_starts(full: Column, tile: Column) -> Column:
    return F.when(full == tile, F.array(F.lit(0))).otherwise(starts_rounded(full, tile, _first_count(full, tile, F.greatest(F.lit(2), F.ceil(full / tile)), strict=True)))


def with_inner(tiles: DataFrame, starts: str, keys: list[str]) -> DataFrame:
    """One row a tile: i, x0, x1 and the inner part inner0..inner1 up to the middle of each overlap. Needs full, tile and the array ``starts``."""
    rows = tiles.select(*keys, "full", "tile", F.col(starts), F.posexplode(starts).alias("i", "x0"))
    s, last = F.col(starts), F.size(starts) - 1
    middle = lambda a, b: F.floor((a + F.col("tile") + b) / 2).cast("int")
    inner0 = F.when(F.col("i") == 0, F.lit(0)).otherwise(middle(s[F.greatest(F.col("i") - 1, F.lit(0))], F.col("x0")))
    inner1 = F.when(F.col("i") == last, F.col("full")).otherwise(middle(F.col("x0"), s[F.least(F.col("i") + 1, last)]))
    return rows.select(*keys, "full", "tile", "i", "x0", (F.col("x0") + F.col("tile")).alias("x1"), inner0.alias("inner0"), inner1.alias("inner1"))


def tile_name(stem: Column, x: Column, y: Column, ext: str = ".png") -> Column:
    return F.format_string("%s-T-%d-%d" + ext, stem, x, y)
