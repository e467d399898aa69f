"""Pluggable feature extractors: ``(ids, contents) -> vectors`` run batch by batch next to the data."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Extractor = Callable[[list[bytes]], np.ndarray]
REGISTRY: dict[str, Callable[[], Extractor]] = {}


def register(name: str, factory: Callable[[], Extractor]) -> None:
    """``factory`` runs once a worker and returns the function for batches (load weights there)."""
    REGISTRY[name] = factory


def extract(images: DataFrame, name: str) -> DataFrame:
    """``id, vec`` of ``id, content`` (binary)."""
    if name not in REGISTRY:
        raise ValueError(f"unknown extractor {name!r}")
    factory = REGISTRY[name]

    def run(frames):
        function = factory()
        for pdf in frames:
            yield pd.DataFrame({"id": pdf["id"], "vec": list(np.asarray(function(pdf["content"].tolist()), np.float64))})

    return images.select("id", "content").mapInPandas(run, "id bigint, vec array<double>")


def by_shape(images: DataFrame, apply: Callable[[np.ndarray], np.ndarray], schema: str = "id bigint, vec array<double>") -> DataFrame:
    """Rows ``id, height, width, content`` stacked by shape within each batch and passed to ``apply`` [n, h, w, c] -> [n, d]."""

    def run(frames):
        for pdf in frames:
            for (h, w), g in pdf.groupby(["height", "width"], sort=False):
                stack = np.stack([np.frombuffer(c, np.uint8).reshape(h, w, -1) for c in g["content"]])
                yield pd.DataFrame({"id": g["id"], "vec": list(np.asarray(apply(stack), np.float64))})

    near = images.repartition("height", "width", F.pmod(F.xxhash64("id"), F.lit(64)))
    return near.mapInPandas(run, schema)


def pca(x: DataFrame, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(mean, components [k, D]) of the centred set, from its D x D scatter."""
    from .moments import moments

    n, mean, scatter = moments(x)
    w, v = np.linalg.eigh(scatter)
    v = v[:, np.argsort(-w)[: min(k, n, len(mean))]].T
    sign = np.sign(v[np.arange(len(v)), np.abs(v).argmax(axis=1)])
    return mean, v * np.where(sign == 0, 1, sign)[:, None]


def project(x: DataFrame, mean: np.ndarray, components: np.ndarray) -> DataFrame:
    def run(frames):
        for pdf in frames:
            yield pd.DataFrame({"id": pdf["id"], "vec": list((np.array(pdf["vec"].tolist(), np.float64) - mean) @ components.T)})

    return x.select("id", "vec").mapInPandas(run, "id bigint, vec array<double>")
