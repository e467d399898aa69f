"""Seeded degradations of pixel arrays."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SEED = 2026
#: Fixed values by severity 1..5: bits kept; gamma and scale of the dark transform; read noise and photons of the sensor.
KEPT_BITS = (6, 5, 4, 3, 2)
DARK_GAMMA, DARK_SCALE, DARK_PHOTONS = (1.5, 1.8, 2.2, 2.6, 3.0), (0.60, 0.50, 0.42, 0.34, 0.26), 255.0 * 0.8
ISO_SIGMA, ISO_PHOTONS = (0.03, 0.06, 0.10, 0.15, 0.20), (60, 25, 12, 5, 3)


def image_seed(image_id: Column, degradation: Column, severity: Column, seed: int = SEED) -> Column:
    """The first eight hex digits of md5("seed|id|degradation|severity") as a number."""
    text = F.concat_ws("|", F.lit(str(seed)), image_id.cast("string"), degradation, severity.cast("string"))
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint")


def color_quant(value: Column, severity: int) -> Column:
    """Drop the low bits of an 8-bit value."""
    low = 8 - KEPT_BITS[severity - 1]
    return F.shiftleft(F.shiftright(value, low), low)


def dark_deterministic(value: Column, severity: int) -> Column:
    """The noise-free part of ``dark``: 0..255 in, expected 0..255 out."""
    return F.pow(value / 255.0, F.lit(DARK_GAMMA[severity - 1])) * F.lit(DARK_SCALE[severity - 1]) * 255.0


def _byte(x: np.ndarray) -> np.ndarray:
    return np.floor(np.clip(x, 0, 255))


def dark(x: np.ndarray, severity: int, rng: np.random.Generator) -> np.ndarray:
    light = (x / 255.0) ** DARK_GAMMA[severity - 1] * DARK_SCALE[severity - 1] * DARK_PHOTONS
    return _byte(rng.poisson(np.maximum(light, 1e-6)) / DARK_PHOTONS * 255.0)


def iso_noise(x: np.ndarray, severity: int, rng: np.random.Generator) -> np.ndarray:
    photons = ISO_PHOTONS[severity - 1]
    shot = rng.poisson(np.clip(x, 0, 255) / 255.0 * photons) / photons * 255.0
    return _byte(shot + rng.normal(0.0, ISO_SIGMA[severity - 1] * 255.0, x.shape))


#: Fixed values by level 1..3 of the simple augmentations.
NOISE, BRIGHTNESS, CONTRAST = (0.02, 0.04, 0.08), (2.0, 4.0, 8.0), (0.2, 0.5, 1.0)
BLUR_SIZE, BLUR_SIGMA, HUE = 11, (2.0, 4.0, 8.0), (0.1, 0.3, 0.5)


def noise(x: np.ndarray, level: int, rng: np.random.Generator) -> np.ndarray:
    return np.clip(x + rng.normal(0.0, NOISE[level - 1] * 255.0, x.shape), 0, 255)


def brighten(x: np.ndarray, level: int, rng: np.random.Generator) -> np.ndarray:
    return np.clip(x * BRIGHTNESS[level - 1], 0, 255)


def flatten_contrast(x: np.ndarray, level: int, rng: np.random.Generator) -> np.ndarray:
    """Blend with the mean."""
    return np.clip(x.mean() + CONTRAST[level - 1] * (x - x.mean()), 0, 255)


def blur(x: np.ndarray, level: int, rng: np.random.Generator) -> np.ndarray:
    """Gaussian of 11 taps along both axes of an image [height, width, ...], mirrored at its borders; square if flat."""
    flat = x.ndim == 1
    side = round(x.size**0.5)
    image = x.reshape(side, side) if flat else x
    half = BLUR_SIZE // 2
    taps = np.exp(-0.5 * (np.arange(-half, half + 1) / BLUR_SIGMA[level - 1]) ** 2)
    taps /= taps.sum()
    for axis in (0, 1):
        wide = np.pad(image, [(half, half) if k == axis else (0, 0) for k in range(image.ndim)], mode="reflect" if image.shape[axis] > half else "symmetric")
        image = sum(t * np.take(wide, np.arange(k, k + image.shape[axis]), axis=axis) for k, t in enumerate(taps))
    return image.reshape(x.shape)


def turn_hue(x: np.ndarray, level: int, rng: np.random.Generator) -> np.ndarray:
    """RGB (last axis, or flat triples): the hue turned by a share of the circle drawn within the level's range."""
    rgb = x.reshape(-1, 3) / 255.0
    top, low = rgb.max(axis=1), rgb.min(axis=1)
    span = top - low
    safe = np.where(span > 0, span, 1)
    r, g, b = rgb.T
    hue = np.where(top == r, (g - b) / safe % 6, np.where(top == g, (b - r) / safe + 2, (r - g) / safe + 4)) / 6
    hue = (hue + rng.uniform(-HUE[level - 1], HUE[level - 1])) % 1
    out = [top - span * np.clip(np.minimum(k, 4 - k), 0, 1) for k in ((n + hue * 6) % 6 for n in (5, 3, 1))]
    return (np.stack(out, axis=1) * 255.0).reshape(x.shape)


REGISTRY = {"dark": dark, "iso_noise": iso_noise, "noise": noise, "brightness_factor": brighten, "contrast_factor": flatten_contrast, "gaussian_blur": blur, "color_jitter": turn_hue}


def register(name: str, function) -> None:
    """Add a degradation ``(array in 0..255, severity, rng) -> array``."""
    REGISTRY[name] = function


def degrade(images: DataFrame, name: str, severity: int) -> DataFrame:
    """``id, vec`` with a registered degradation applied; noise depends on the id alone, not on the partitioning."""
    if name not in REGISTRY:
        raise KeyError(name)
    apply = REGISTRY[name]
    seeded = images.select("id", "vec", image_seed(F.col("id"), F.lit(name), F.lit(severity)).alias("seed"))

    def run(frames):
        for pdf in frames:
            yield pd.DataFrame({"id": pdf["id"], "vec": [apply(np.asarray(v, np.float64), severity, np.random.default_rng(int(s))) for v, s in zip(pdf["vec"], pdf["seed"], strict=True)]})

    return seeded.mapInPandas(run, "id bigint, vec array<double>")
