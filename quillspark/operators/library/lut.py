"""3-D lookup tables: parsing of .cube files and blending at a strength."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MOST_POINTS = 129  # per axis: bounds what is broadcast


def read_cube(spark: SparkSession, path: str) -> np.ndarray:
    """The table of a .cube file, indexed [r][g][b]; red varies fastest in the file."""
    lines = [r.value.strip() for r in spark.read.text(path, wholetext=False).limit(MOST_POINTS**3 + 1000).collect()]
    size = next((int(x.split()[1]) for x in lines if x.upper().startswith("LUT_3D_SIZE")), 0)
    rows = [tuple(map(float, x.split())) for x in lines if x and (x[0].isdigit() or x[0] in "+-.")]
    if not 2 <= size <= MOST_POINTS or len(rows) != size**3:
        raise ValueError("not a 3-D lookup table")
    return np.array(rows).reshape(size, size, size, 3).transpose(2, 1, 0, 3)


def blend(pixels: DataFrame, table: np.ndarray, strength: float) -> DataFrame:
    """``x * (1 - s) + lut(x) * s`` for columns r, g, b in 0..1, by trilinear interpolation; s from 0 to 1."""
    shared = pixels.sparkSession.sparkContext.broadcast(table)
    names = pixels.columns

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        lut = shared.value
        top = lut.shape[0] - 1
        for batch in batches:
            x = batch[["r", "g", "b"]].to_numpy(dtype=float)
            at = np.clip(x, 0, 1) * top
            low = np.minimum(at.astype(int), top - 1)
            part = at - low
            out = np.zeros_like(x)
            for corner in np.ndindex(2, 2, 2):
                weight = np.prod(np.where(corner, part, 1 - part), axis=1)
                i = low + corner
                out += weight[:, None] * lut[i[:, 0], i[:, 1], i[:, 2]]
            batch[["r", "g", "b"]] = x * (1 - strength) + out * strength
            yield batch[names]

    return pixels.withColumns({c: F.col(c).cast("double") for c in "rgb"}).mapInPandas(run, pixels.withColumns({c: F.col(c).cast("double") for c in "rgb"}).schema)
