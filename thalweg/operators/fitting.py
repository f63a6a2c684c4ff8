"""Least squares fit of growth curves."""

from __future__ import annotations

from typing import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.growth import Curve
from ..session import broadcast_if_small, stored


def fit_growth_curve(points: DataFrame, degree: int = 6) -> DataFrame:
    """Polynomial of each species through ``species, temperature, growth_rate``.

    Spark sums the powers of the temperature, mapped to [-1, 1], in one
    aggregation; what is left per species is one small linear system, solved in
    the task that holds its row of sums.  A species whose points share one
    temperature is fitted over that temperature and one to either side.  Returns ``species, low, high,
    coefficients, scaled_coefficients`` with the constant term first.
    """
    valid = points.where("temperature IS NOT NULL AND growth_rate IS NOT NULL")
    domain = stored(
        valid.groupBy("species")
        .agg(F.min("temperature").alias("low"), F.max("temperature").alias("high"))
        .select(
            "species",
            F.when(F.col("low") == F.col("high"), F.col("low") - 1).otherwise(F.col("low")).alias("low"),
            F.when(F.col("low") == F.col("high"), F.col("high") + 1).otherwise(F.col("high")).alias("high"),
        ),
        "domain",
    )
    u = (2 * F.col("temperature") - F.col("low") - F.col("high")) / (F.col("high") - F.col("low"))
    scaled = (
        valid.join(broadcast_if_small(domain), "species")
        .select("species", "low", "high", F.col("growth_rate").alias("y"), u.alias("u"))
    )
    powers = [F.lit(1.0)]
    for _ in range(2 * degree):
        powers.append(powers[-1] * F.col("u"))
    sums = scaled.groupBy("species", "low", "high").agg(
        F.array(*[F.sum(p) for p in powers]).alias("moments"),
        F.array(*[F.sum(p * F.col("y")) for p in powers[: degree + 1]]).alias("targets"),
    )

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        order = np.arange(degree + 1)
        for batch in batches:
            rows = []
            for row in batch.itertuples(index=False):
                gram = np.asarray(row.moments)[order[:, None] + order[None, :]]
                solution = np.linalg.lstsq(gram, np.asarray(row.targets), rcond=None)[0]
                model = np.polynomial.Polynomial(solution, domain=[row.low, row.high])
                plain = np.zeros(degree + 1)
                converted = model.convert().coef
                plain[: len(converted)] = converted
                rows.append((row.species, row.low, row.high, plain.tolist(), solution.tolist()))
            yield pd.DataFrame(rows, columns=["species", "low", "high", "coefficients", "scaled_coefficients"])

    kind = points.schema["species"].dataType.simpleString()
    return sums.mapInPandas(
        solve,
        f"species {kind}, low double, high double, coefficients array<double>, scaled_coefficients array<double>",
    )


def fitted_curve(fits: DataFrame, species: str) -> Curve:
    """The fit of one species as a curve for the growth expression."""
    row = fits.where(F.col("species") == species).first()
    if row is None:
        raise ValueError(f"no curve for species {species!r}")
    return Curve(row["species"], tuple(row["coefficients"]), row["low"], row["high"])
