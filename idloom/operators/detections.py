"""Post-processing of a field detector's boxes."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from idloom.functions.text import round_half_up
from idloom.session import prepare

# The classes that are fields, least score, overlap from which a box is suppressed, input side.
FIELDS = {1: "surname", 2: "name", 17: "patronymic"}
LEAST_SCORE, OVERLAP, SIDE = 0.7, 0.2, 640


def best_class(detections: DataFrame, least: float = LEAST_SCORE, fields: dict[int, str] = FIELDS) -> DataFrame:
    """Detections whose best class is a field: image_id, anchor_idx, cls, field, score and corner box x1 to y2."""
    score = F.array_max("scores")
    cls = (F.array_position("scores", score) - 1).cast("int")
    names = F.create_map(*(F.lit(x) for kv in fields.items() for x in kv))
    half = lambda c, d, sign: F.col(c) + sign * F.col(d) / 2
    found = detections.select("image_id", "anchor_idx", cls.alias("cls"), score.cast("double").alias("score"), half("cx", "bw", -1).alias("x1"), half("cy", "bh", -1).alias("y1"), half("cx", "bw", 1).alias("x2"), half("cy", "bh", 1).alias("y2"))
    return found.where((F.col("score") > 0) & (F.col("score") >= least) & F.col("cls").isin(list(fields))).withColumn("field", names[F.col("cls")])


def iou(a: str, b: str) -> Column:
    """Intersection over union of the boxes in struct columns a and b; 0 without an area."""
    c = lambda s, k: F.col(f"{s}.{k}")
    inter = F.greatest(F.lit(0.0), F.least(c(a, "x2"), c(b, "x2")) - F.greatest(c(a, "x1"), c(b, "x1"))) * F.greatest(F.lit(0.0), F.least(c(a, "y2"), c(b, "y2")) - F.greatest(c(a, "y1"), c(b, "y1")))
    area = lambda s: (c(s, "x2") - c(s, "x1")) * (c(s, "y2") - c(s, "y1"))
    union = area(a) + area(b) - inter
    return F.when(union > 0, inter / union).otherwise(0.0)


#: Pixels of a side of the cells in which overlapping boxes meet.
CELL = 64.0


def overlaps(boxes: DataFrame, least: float = OVERLAP, cell: float = CELL) -> DataFrame:
    """image_id, cls, first, second, iou of the boxes(image_id, cls, anchor_idx, x1, y1, x2, y2) that overlap at least so far.

    Boxes meet in the cells of a grid that they touch, and a pair counts in the one cell that holds the upper left corner of what
    they share: boxes far apart are never compared, and no pair is compared twice.
    """
    if least <= 0:
        raise ValueError("boxes that share nothing are not looked for")
    cells = lambda a, b: F.explode(F.sequence(F.floor(F.col(a) / cell), F.floor(F.col(b) / cell)))
    placed = boxes.where("x2 > x1 and y2 > y1").select("image_id", "cls", F.struct("anchor_idx", "x1", "y1", "x2", "y2").alias("box"), "x1", "x2", "y1", "y2").withColumn("cx", cells("x1", "x2")).withColumn("cy", cells("y1", "y2"))
    key = ["image_id", "cls", "cx", "cy"]
    a, b = (placed.select(*key, F.col("box").alias(n)) for n in "ab")
    home = lambda c, axis: F.floor(F.greatest(F.col(f"a.{c}"), F.col(f"b.{c}")) / cell) == F.col(axis)
    pairs = a.join(b, key).where((F.col("a.anchor_idx") < F.col("b.anchor_idx")) & home("x1", "cx") & home("y1", "cy")).withColumn("iou", iou("a", "b"))
    return pairs.where(F.col("iou") >= least).select("image_id", "cls", F.col("a.anchor_idx").alias("first"), F.col("b.anchor_idx").alias("second"), "iou")


def _kept(boxes: pd.DataFrame) -> pd.DataFrame:
    boxes = boxes.sort_values(["score", "anchor_idx"], ascending=[False, True], kind="stable")
    x1, y1, x2, y2 = (boxes[c].to_numpy() for c in ("x1", "y1", "x2", "y2"))
    area = (x2 - x1) * (y2 - y1)
    alive, keep = np.ones(len(boxes), bool), []
    for i in range(len(boxes)):
        if not alive[i]:
            continue
        keep.append(i)
        inter = np.clip(np.minimum(x2, x2[i]) - np.maximum(x1, x1[i]), 0, None) * np.clip(np.minimum(y2, y2[i]) - np.maximum(y1, y1[i]), 0, None)
        union = area + area[i] - inter
        alive[i + 1 :] &= ~(np.divide(inter, union, out=np.zeros(len(boxes)), where=union > 0) >= OVERLAP)[i + 1 :]
    return boxes.iloc[keep]


def nms(best: DataFrame) -> DataFrame:
    """Non-maximum suppression for each image and class; a group is one image's boxes after the score filter."""
    prepare(best.sparkSession)
    return best.groupBy("image_id", "cls").applyInPandas(_kept, best.schema)


def best_box(best: DataFrame) -> DataFrame:
    """The top box of each image and field (the first anchor of equals); what suppression keeps first."""
    top = best.groupBy("image_id", "field").agg(F.min(F.struct((-F.col("score")).alias("s"), "anchor_idx", "x1", "y1", "x2", "y2")).alias("b"))
    return top.select("image_id", "field", *(F.col(f"b.{c}").alias(c) for c in ("x1", "y1", "x2", "y2")), (-F.col("b.s")).alias("conf"))


def letterbox(dims: DataFrame, side: int = SIDE) -> DataFrame:
    """dims(image_id, w, h) with scale r and the paddings dw, dh on each side."""
    r = F.least(side / F.col("w"), side / F.col("h"))
    return dims.withColumn("r", r).withColumns({"dw": (side - round_half_up(F.col("w") * F.col("r"))) / 2, "dh": (side - round_half_up(F.col("h") * F.col("r"))) / 2})


def unscale(boxes: DataFrame, dims: DataFrame) -> DataFrame:
    """Boxes of the model's input in the pixels of their images."""
    j = boxes.join(letterbox(dims), "image_id")
    at = lambda c, d: round_half_up((F.col(c) - F.col(d)) / F.col("r"))
    new = {"x1": F.greatest(F.lit(0), at("x1", "dw")), "y1": F.greatest(F.lit(0), at("y1", "dh")), "x2": F.least(F.col("w"), at("x2", "dw")), "y2": F.least(F.col("h"), at("y2", "dh"))}
    return j.select("image_id", "field", *(v.cast("long").alias(k) for k, v in new.items()), "conf")


def fields_of_images(boxes: DataFrame, fields: dict[int, str] = FIELDS) -> DataFrame:
    """One row per image with a struct box for each field."""
    return boxes.groupBy("image_id").pivot("field", list(fields.values())).agg(F.first(F.struct("x1", "y1", "x2", "y2", "conf")))
