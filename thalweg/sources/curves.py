"""Growth curve points."""

from __future__ import annotations

import re
from typing import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .readings import qualified

# Column names of a growth curve file.
TEMPERATURE = "Temperature.C"
RATE = "Specific.Growth.Rate.g.g.d"


def read_growth_curves(spark: SparkSession, paths: Mapping[str, str]) -> DataFrame:
    """Points of each species' file: ``species, temperature, growth_rate``.

    Columns are found by name in each file's own first line, so a leading index
    column does no harm; a file that lacks one fails the job.  All files are
    read in one scan, a file at a time: a curve is a few thousand points.
    """
    if not paths:
        raise ValueError("no curve files given")
    place = F.regexp_replace(
        F.url_decode(F.replace("_metadata.file_path", F.lit("+"), F.lit("%2B"))), "^([A-Za-z][A-Za-z0-9+.-]*:)/+", "$1/"
    )
    owner = F.lit(None).cast("string")
    for species, path in paths.items():
        top = re.sub("^([A-Za-z][A-Za-z0-9+.-]*:)/+", r"\1/", qualified(spark, path))
        owner = F.when((place == top) | F.startswith(place, F.lit(top + "/")), species).otherwise(owner)
    cells = lambda line: F.transform(F.split(line, ","), lambda c: F.trim(c, F.lit('" ')))
    lines = F.filter(F.split("value", r"\r?\n"), lambda line: line != "")
    files = spark.read.text(list(paths.values()), wholetext=True).select(owner.alias("species"), lines.alias("lines"))
    files = files.where(F.size("lines") > 0).withColumn("head", cells(F.col("lines")[0]))
    at = {name: F.array_position("head", name) for name in (TEMPERATURE, RATE)}
    lacking = F.raise_error(F.lit(f"a curve file lacks {TEMPERATURE} or {RATE}"))
    number = lambda name: F.when(at[name] == 0, lacking).otherwise(
        F.get(cells(F.col("line")), (at[name] - 1).cast("int")).try_cast("double")
    )
    rows = files.select("species", "head", F.explode(F.slice("lines", F.lit(2), F.size("lines"))).alias("line"))
    return rows.select("species", number(TEMPERATURE).alias("temperature"), number(RATE).alias("growth_rate"))
