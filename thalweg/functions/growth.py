"""Temperature to fish growth, as a codegen-friendly polynomial."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Curve:
    """Fitted curve of a species: power-basis coefficients c0..cn and data domain."""

    species: str
    coefficients: tuple[float, ...]
    low: float
    high: float


# Degree-6 least squares fits of the two published species
# tables, growth in g/g/day against degrees Celsius.
RED_BAND_TROUT = Curve(
    "Red Band Trout (10g)",
    (
        -0.002440113451485642,
        0.00048568768832049327,
        -0.0001109992823774311,
        3.6056043089452506e-05,
        -3.905046889262342e-06,
        1.7635084352743e-07,
        -2.934266953901731e-09,
    ),
    0.0,
    25.0,
)
CHINOOK_SALMON = Curve(
    "Chinook Salmon (20g)",
    (
        -0.014149863761141706,
        0.006346391808647664,
        -0.0013929392327488022,
        0.00020626532000693313,
        -1.658167697652586e-05,
        6.400341215588918e-07,
        -9.471813751850519e-09,
    ),
    4.0,
    25.0,
)
CURVES = {curve.species: curve for curve in (RED_BAND_TROUT, CHINOOK_SALMON)}

# Above 25 degrees every species gets -15; growth is reported in
# percent per ten days, a thousand times g/g/day.
LETHAL_TEMPERATURE = 25.0
LETHAL_GROWTH = -15.0
PER_TEN_DAYS = 1000.0


def polynomial(x: Column, coefficients: Sequence[float | Column]) -> Column:
    """Horner evaluation, constant term first."""
    terms = [c if isinstance(c, Column) else F.lit(float(c)) for c in coefficients]
    total = terms[-1]
    for term in reversed(terms[:-1]):
        total = total * x + term
    return total


def _guarded(t: Column, rate: Column) -> Column:
    # Spark orders NaN above every number, so NaN must leave before the clamp.
    return F.when(F.isnan(t), t).when(t > LETHAL_TEMPERATURE, F.lit(LETHAL_GROWTH)).otherwise(rate * PER_TEN_DAYS)


def growth(temperature: Column | str, curve: Curve | Sequence[float]) -> Column:
    """Growth in percent per ten days; null stays null and NaN stays NaN."""
    t = (F.col(temperature) if isinstance(temperature, str) else temperature).cast("double")
    coefficients = curve.coefficients if isinstance(curve, Curve) else curve
    return _guarded(t, polynomial(t, coefficients))


def growth_by_species(
    temperature: Column | str, species: Column | str, curves: Mapping[str, Curve] = CURVES
) -> Column:
    """Growth where each row names its species; an unknown species gives null."""
    t = (F.col(temperature) if isinstance(temperature, str) else temperature).cast("double")
    named = F.col(species) if isinstance(species, str) else species
    rate = F.lit(None).cast("double")
    for name, curve in curves.items():
        rate = F.when(named == name, polynomial(t, curve.coefficients)).otherwise(rate)
    known = named.isin(list(curves))
    return F.when(known, _guarded(t, rate))


def growth_curve_table(curves: DataFrame, points: int = 100) -> DataFrame:
    """Evenly spaced temperatures over each curve's domain with the fitted rate.

    ``curves`` has ``species, low, high, coefficients`` (array, constant first).
    """
    spaced = curves.select(
        "species", "low", "high", "coefficients", F.explode(F.sequence(F.lit(0), F.lit(points - 1))).alias("point")
    ).withColumn("temperature", F.col("low") + (F.col("high") - F.col("low")) * F.col("point") / F.lit(points - 1))
    fitted = F.aggregate(
        F.reverse("coefficients"), F.lit(0.0), lambda total, c: total * F.col("temperature") + c
    )
    return spaced.select("species", "point", "temperature", fitted.alias("growth_rate"))
