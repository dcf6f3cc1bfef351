"""Names: editions, layouts, assets, tiles, task queues."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .dims import LARGE_LAYOUTS


def edition_id(day: Column, part: Column, page: Column) -> Column:
    """SNP2436020X-YYYYMMDD-<0 morning, 1 evening>-<page>-0-0."""
    return F.format_string("SNP2436020X-%s-%d-%d-0-0", F.date_format(day, "yyyyMMdd"), F.when(part == "A", 1).otherwise(0), page)


LAYOUT = r"^layout_(\d+)x(\d+)(?:_T(\d+)x(\d+))?$"


def layout_part(name: Column, group: int) -> Column:
    """A number of a layout name: 1 width, 2 height, 3 and 4 of the tile; null where there is none."""
    return F.nullif(F.regexp_extract(name, LAYOUT, group), F.lit("")).cast("int")


def layout_name(w: Column, h: Column, tw: Column, th: Column) -> Column:
    base = F.format_string("layout_%dx%d", w, h)
    return F.when(tw.isNull(), base).otherwise(F.concat(base, F.format_string("_T%dx%d", tw, th)))


def asset_path(day: Column, kind: str, stem: Column, ext: str, prefix: str = "") -> Column:
    return F.concat_ws("/", day, F.lit(kind), F.concat(F.lit(prefix), stem, F.lit(ext)))


def suffix_of_tile(name: Column) -> Column:
    return F.nullif(F.regexp_extract(name, r"(T-\d+-\d+)\.", 1), F.lit(""))


def task_gpu(backbone: Column, model: Column, layout: Column) -> Column:
    """The card that a run needs."""
    large = layout.isin(*LARGE_LAYOUTS) | ((backbone == "seresnext50") & layout.isin("layout_896x1280_T512x768", "layout_768x1280_T768x512"))
    deep = backbone.isin("seresnet50", "efficientnetb2") | (backbone.isin("efficientnetb1", "seresnext50", "inceptionresnetv2") & (model == "fpn"))
    return F.when(large | deep, F.lit("v100")).otherwise(F.lit("rtx2080ti"))


def patched_batchsize(batchsize: Column, backbone: Column, model: Column, layout: Column) -> Column:
    heavy = (backbone == "seresnext50") & (model == "fpn") & layout.isin(*LARGE_LAYOUTS)
    return F.when(heavy, F.floor(batchsize / 3)).otherwise(batchsize).cast("int")


def relabelled(labels: Column, illustrations: Column) -> Column:
    return F.when(F.coalesce(illustrations, F.lit(False)), F.lit("blkx")).when(labels == "txt", F.lit("blk")).otherwise(labels)
