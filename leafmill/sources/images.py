"""Pictures as rows."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.functions.images import PIXELS, fit, pack


@F.pandas_udf(PIXELS)
def _rgba(images: pd.DataFrame) -> pd.DataFrame:
    """From the image source's rows, whose channels are blue first."""
    out = []
    for w, h, n, data in zip(images["width"], images["height"], images["nChannels"], images["data"]):
        x = np.frombuffer(bytes(data), np.uint8).reshape(int(h), int(w), int(n))
        x = np.repeat(x, 3, axis=2) if n == 1 else x
        alpha = x[..., 3:4] if n == 4 else np.full((int(h), int(w), 1), 255, np.uint8)
        out.append(pack(np.concatenate([x[..., 2::-1], alpha], axis=2)))
    return pd.DataFrame(out)


def read_images(spark: SparkSession, path: str, longest: int = 0) -> DataFrame:
    """``(origin, image struct<width, height, data>)`` of every picture that decodes, at most ``longest`` on its longer edge; 0 leaves them."""
    found = spark.read.format("image").option("dropInvalid", True).load(path)

    @F.pandas_udf(PIXELS)
    def smaller(images: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([pack(fit(np.frombuffer(bytes(d), np.uint8).reshape(int(h), int(w), 4), longest)) for w, h, d in zip(images["width"], images["height"], images["data"])])

    rgba = found.select(F.col("image.origin").alias("origin"), _rgba("image").alias("image"))
    return rgba.select("origin", smaller("image").alias("image")) if longest else rgba


def thumbnails(images: DataFrame, size: int = 320) -> DataFrame:
    from leafmill.functions.images import fit_udf

    return images.withColumn("thumb", fit_udf("image", F.lit(size)))
