import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from thalweg.functions.growth import CHINOOK_SALMON, CURVES, RED_BAND_TROUT, growth, growth_by_species, growth_curve_table
from thalweg.operators.fitting import fit_growth_curve, fitted_curve
from thalweg.sources.curves import read_growth_curves

TEMPERATURES = [-1.0, 0.0, 5.0, 10.0, 15.0, 20.0, 24.0, 25.0, 25.01]
GOLDEN = {
    RED_BAND_TROUT: [-3.076941, -2.440113, -0.215058, 3.023227, 4.359797, 3.044384, -8.412981, -15.903302, -15],
    CHINOOK_SALMON: [-22.112691, -14.149864, 0.030341, 5.000280, 2.468777, -5.430368, -27.900874, -42.520344, -15],
}
TROUT_POINTS = [
    (0.0, -2.5e-3), (2.5, -1.25e-3), (5.0, -5e-4), (7.5, 1.5e-3), (10.0, 3e-3), (12.5, 4.25e-3),
    (15.0, 4.5e-3), (17.5, 3.75e-3), (20.0, 2.5e-3), (22.5, 1.25e-3), (23.75, -1e-2), (25.0, -1.5e-2),
]


@pytest.mark.parametrize("curve", [RED_BAND_TROUT, CHINOOK_SALMON])
def test_golden_values(spark, curve):
    df = spark.createDataFrame(list(enumerate(TEMPERATURES)), "i int, t double")
    got = [r[0] for r in df.orderBy("i").select(F.round(growth("t", curve), 6)).collect()]
    assert got == pytest.approx(GOLDEN[curve], abs=1e-6)


def test_nan_stays_nan_and_null_stays_null(spark):
    df = spark.createDataFrame([(1, float("nan")), (2, None), (3, float("inf"))], "i int, t double")
    got = {r.i: r.g for r in df.select("i", growth("t", RED_BAND_TROUT).alias("g")).collect()}
    assert math.isnan(got[1]) and got[2] is None and got[3] == -15.0


def test_by_species(spark):
    df = spark.createDataFrame([(RED_BAND_TROUT.species,), (CHINOOK_SALMON.species,), ("other",), (None,)], "s string")
    got = {r.s: r.g for r in df.select("s", growth_by_species(F.lit(10.0), "s").alias("g")).collect()}
    assert got[RED_BAND_TROUT.species] == pytest.approx(3.023227, abs=1e-6)
    assert got[CHINOOK_SALMON.species] == pytest.approx(5.000280, abs=1e-6)
    assert got["other"] is None and got[None] is None
    assert set(CURVES) == {RED_BAND_TROUT.species, CHINOOK_SALMON.species}


def test_fit_from_file(spark, tmp_path):
    """A file with an index column gives the published trout coefficients."""
    path = tmp_path / "trout.csv"
    lines = ['"","Temperature.C","Specific.Growth.Rate.g.g.d"'] + [f'"{i}",{x},{y}' for i, (x, y) in enumerate(TROUT_POINTS)]
    path.write_text("\n".join(lines))
    fits = fit_growth_curve(read_growth_curves(spark, {"trout": str(path)}))
    curve = fitted_curve(fits, "trout")
    assert curve.coefficients == pytest.approx(RED_BAND_TROUT.coefficients, rel=1e-9)
    assert (curve.low, curve.high) == (0.0, 25.0)
    with pytest.raises(ValueError):
        fitted_curve(fits, "pike")


def test_fit_equals_numpy(spark):
    rng = np.random.default_rng(7)
    x = np.sort(rng.uniform(2, 27, 200))
    rows = [(s, float(a), float(np.sin(a / k))) for k, s in ((3, "a"), (5, "b")) for a in x]
    fits = fit_growth_curve(spark.createDataFrame(rows, "species string, temperature double, growth_rate double"))
    for row in fits.collect():
        y = [r[2] for r in rows if r[0] == row.species]
        want = np.polynomial.Polynomial.fit(x, y, deg=6)
        assert row.scaled_coefficients == pytest.approx(want.coef.tolist(), abs=1e-9)


def test_curve_table(spark):
    curves = spark.createDataFrame(
        [("trout", 0.0, 25.0, list(RED_BAND_TROUT.coefficients))],
        "species string, low double, high double, coefficients array<double>",
    )
    rows = growth_curve_table(curves).orderBy("point").collect()
    assert len(rows) == 100 and rows[0].temperature == 0.0 and rows[-1].temperature == 25.0
    want = np.polynomial.Polynomial(RED_BAND_TROUT.coefficients)(np.linspace(0, 25, 100))
    assert [r.growth_rate for r in rows] == pytest.approx(want.tolist(), abs=1e-12)
