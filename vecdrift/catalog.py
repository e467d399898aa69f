"""Dimension tables: conditions, datasets, models, metrics, spaces."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Degradation families in order; each has severities 1 to 5, and ('clean', 0) comes first.
DEGRADATIONS = (
    "gaussian_noise", "shot_noise", "impulse_noise", "iso_noise", "defocus_blur", "glass_blur", "motion_blur", "zoom_blur", "snow", "frost", "fog",
    "brightness", "dark", "contrast", "color_quant", "elastic_transform", "pixelate", "jpeg_compression",
)
SEVERITIES = (1, 2, 3, 4, 5)
#: Spaces compared by cosine, other names of spaces.
COSINE_SPACES = frozenset({"clip_vitb32"})
SPACE_ALIASES = {"clip_vit_b32": "clip_vitb32", "lpips_vgg": "vgg_lpips"}
#: Fixed values: +1 if a larger metric means a larger shift, -1 if smaller.
METRICS = (
    ("FID", "distribution", 1), ("KID", "distribution", 1), ("FD@DINOv2", "distribution", 1), ("KD@DINOv2", "distribution", 1),
    ("Cos@Inc", "image", -1), ("CLIP-sim", "image", -1), ("Cos@VGG", "image", -1), ("LPIPS", "image", 1), ("CPL", "image", 1), ("SSS", "image", 1),
    ("SSIM", "image", -1), ("MSE", "image", 1), ("TSI", "image", 1), ("WD", "image", 1), ("KL", "image", 1), ("HistI", "image", -1),
)
#: Models with task, dataset, score column and whether a larger score is better.
MODELS = (
    ("SMOKE", "detection", "kitti_det", "ap3d_mod_r40", True), ("PGD", "detection", "kitti_det", "ap3d_mod_r40", True),
    ("DeepLabV3+", "segmentation", "cityscapes", "miou", True), ("Mask2Former", "segmentation", "cityscapes", "miou", True), ("DLv3+/KITTI", "segmentation", "kitti_seg", "miou", True),
    ("Monodepth2", "depth", "kitti_depth", "abs_rel", False), ("MD2 mono+st", "depth", "kitti_depth", "abs_rel", False),
)
#: Raw label -> training label of the segmentation maps; all others are ignored.
LABEL_TO_TRAIN = {7: 0, 8: 1, 11: 2, 12: 3, 13: 4, 17: 5, 19: 6, 20: 7, 21: 8, 22: 9, 23: 10, 24: 11, 25: 12, 26: 13, 27: 14, 28: 15, 31: 16, 32: 17, 33: 18}


def models(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(MODELS), "model string, task string, dataset string, score string, higher_better boolean")


def canonical_space(name: str) -> str:
    return SPACE_ALIASES.get(name, name)


def conditions(spark: SparkSession) -> DataFrame:
    """``degradation, severity, ordinal``: clean, then every family at every severity."""
    rows = [("clean", 0)] + [(d, s) for d in DEGRADATIONS for s in SEVERITIES]
    return spark.createDataFrame([(d, s, i) for i, (d, s) in enumerate(rows)], "degradation string, severity int, ordinal int")


def metrics(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(METRICS), "metric string, level string, direction int")


def ordered_metrics(columns: list[str], level: str | None = None) -> list[str]:
    """The catalogue's metrics that are among the columns, in catalogue order."""
    return [m for m, at, _ in METRICS if m in columns and level in (None, at)]
