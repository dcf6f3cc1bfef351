"""Small fixed dimensions of page segmentation as DataFrames and literals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Label code, name, colour, and priority when several labels meet in one cell.
LABELS = (
    (0, "BACKGROUND", (255, 255, 255), 2.0),
    (1, "FRAKTUR_BG", (0, 249, 0), 1.0),
    (2, "FRAKTUR_SM", (255, 64, 255), 1.0),
    (3, "ANTIQUA_BG", (255, 251, 0), 1.0),
    (4, "ANTIQUA_SM", (170, 121, 66), 1.0),
    (5, "TABTXT", (255, 147, 0), 1.0),
    (6, "BORDER", (168, 211, 170), 1.0),
    (7, "TABCOL", (242, 148, 138), 3.0),
    (8, "H", (255, 38, 0), 4.0),
    (9, "V", (0, 48, 255), 5.0),
    (10, "H_SM", (0, 253, 255), 1.0),
    (11, "ILLUSTRATION", (163, 215, 223), 1.0),
    (12, "LINE", (80, 200, 20), 1.0),
)
# Class name and the labels that it gathers; the order is the class index.
CLASSES = (
    ("background", (0,)),
    ("text", (1, 2, 3, 4)),
    ("tabelleninhalt", (5,)),
    ("illustration", (6, 11, 10)),
    ("tab", (7,)),
    ("h", (8,)),
    ("v", (9,)),
)
# The parameter grid of the training runs.
BACKBONES = ("resnet34", "resnet50", "seresnet34", "seresnet50", "vgg16", "inceptionv3", "efficientnetb1", "efficientnetb2", "seresnext50", "inceptionresnetv2")
MODELS = ("fpn", "unet")
# Backbone and its family in the result tables.
FAMILIES = {
    "resnet18": "resnet",
    "resnet34": "resnet",
    "resnet50": "resnet",
    "seresnet18": "seresnet",
    "seresnet34": "seresnet",
    "seresnet50": "seresnet",
    "efficientnetb0": "efficientnet",
    "efficientnetb1": "efficientnet",
    "efficientnetb2": "efficientnet",
    "inceptionv3": "inceptionv3",
    "vgg16": "vgg16",
}
LAYOUTS = ("layout_512x768", "layout_768x1280_T768x512", "layout_896x1280_T512x768", "layout_640x1024_T384x1024", "layout_896x1280_T256x1280", "layout_896x1280_T896x384", "layout_896x1280", "layout_1280x2400_T1280x896", "layout_1640x2400_T896x1280")
LARGE_LAYOUTS = ("layout_896x1280", "layout_1280x2400_T1280x896", "layout_1640x2400_T896x1280")
TEXT_LABELS = (1, 2, 3, 4, 5)
SEPARATOR_LABELS = (7, 8, 9)


def labels(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(c, n, *rgb, w) for c, n, rgb, w in LABELS], "code int, name string, r int, g int, b int, weight double")


def class_codes(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(i, n, list(x)) for i, (n, x) in enumerate(CLASSES)], "idx int, name string, labels array<int>")


def literal_map(pairs: dict) -> Column:
    return F.create_map(*[F.lit(x) for kv in pairs.items() for x in kv])


def class_of(label: Column) -> Column:
    """Class index of a label code; labels in no class are background."""
    return F.coalesce(literal_map({c: i for i, (_, x) in enumerate(CLASSES) for c in x})[label], F.lit(0))


def weight_of(label: Column) -> Column:
    return F.coalesce(literal_map({c: w for c, _, _, w in LABELS})[label], F.lit(1.0))
