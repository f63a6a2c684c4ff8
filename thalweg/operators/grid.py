"""Join of boxes of very unlike sizes, by equality over a hierarchy of grids.

Cells of level n are 4**n wide.  A box lives on the lowest level whose cells
are at least as wide as it is, so it touches at most two cells along each axis,
four in all, whatever its size.  Boxes of one level meet in a cell; boxes of
different levels meet in the larger one's cell, to which the smaller lifts its
own: a cell is its four-by-four children's ancestor.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Width of a cell over that of its children.
STEP = 4.0
#: No cell is narrower: points live on the level of this width, or on the lowest that the other side has.
LEAST = 1e-9
#: Rows that a box is listed in: at its own level, or lifted to the level of larger ones.
OWN, LIFTED = 0, 1

Box = tuple[str, str, str, str]


def level_of(box: tuple[Column, Column, Column, Column], least: float = LEAST) -> Column:
    """The level of a box ``min_x, min_y, max_x, max_y``."""
    wide = F.greatest(box[2] - box[0], box[3] - box[1], F.lit(float(least)))
    return F.ceil(F.log(STEP, wide)).cast("int")


def _width(level: Column) -> Column:
    return F.pow(F.lit(STEP), level.cast("double"))


def _place(value: Column, level: Column) -> Column:
    return F.floor(value / _width(level)).cast("long")


def _at(level: Column | int, kind: int) -> Column:
    level = F.lit(level) if isinstance(level, int) else level
    return F.struct(level.cast("int").alias("level"), F.lit(kind).alias("kind"))


def _listed(rows: DataFrame, box: tuple[Column, Column, Column, Column], levels: Column, prefix: str) -> DataFrame:
    """A row per level and cell that the box touches there."""
    at = F.col(f"{prefix}_at")
    rows = rows.withColumn(f"{prefix}_at", F.explode(levels))
    for name, low, high in (("cx", box[0], box[2]), ("cy", box[1], box[3])):
        rows = rows.withColumn(name, F.explode(F.sequence(_place(low, at["level"]), _place(high, at["level"]))))
    return rows.select("*", at["level"].alias("level"), at["kind"].alias("kind")).drop(f"{prefix}_at")


def _known(box: Box) -> Column:
    known = F.lit(True)
    for c in box:
        known = known & F.col(c).isNotNull() & ~F.isnan(c)
    return known


def cell_rows(left: DataFrame, right: DataFrame, left_box: Box, right_box: Box, least: float = LEAST) -> tuple[DataFrame, DataFrame] | None:
    """Both sides with the columns ``level, kind, cx, cy`` by which they meet; none if one of them can't meet anything.

    One job reads the right side's boxes for their levels, of which there are
    a few dozen at most, and their total bounds, to which the left side's boxes
    are cut.  Left rows lift to the levels where right ones live, right rows to
    all above their own; a left row looks among lifted ones only if it is
    larger than the smallest right one.
    """
    b = tuple(F.col(c) for c in right_box)
    right = right.where(_known(right_box))
    seen = right.agg(
        F.min(b[0]).alias("x0"), F.min(b[1]).alias("y0"), F.max(b[2]).alias("x1"), F.max(b[3]).alias("y1"),
        F.collect_set(level_of(b, least)).alias("levels"),
    ).first()
    if not seen["levels"]:
        return None
    whole = tuple(F.lit(seen[c]) for c in ("x0", "y0", "x1", "y1"))
    levels = sorted(seen["levels"])
    # the total bounds touch at most four cells of this level, and so does everything that is cut to them
    top = F.greatest(level_of(whole), F.lit(levels[-1]))
    own = level_of(b, least)
    above = F.when(own < top, F.transform(F.sequence(own + 1, top), lambda n: _at(n, LIFTED)))
    right_levels = F.concat(F.array(_at(own, OWN)), F.coalesce(above, F.array().cast("array<struct<level:int,kind:int>>")))

    a = tuple(F.col(c) for c in left_box)
    left = left.where(_known(left_box) & (a[0] <= whole[2]) & (a[1] <= whole[3]) & (a[2] >= whole[0]) & (a[3] >= whole[1]))
    cut = (F.greatest(a[0], whole[0]), F.greatest(a[1], whole[1]), F.least(a[2], whole[2]), F.least(a[3], whole[3]))
    own = F.least(F.greatest(level_of(cut, least), F.lit(levels[0])), top)
    left_levels = F.array_compact(
        F.array(*[F.when(own <= n, _at(n, OWN)) for n in levels], F.when(own > levels[0], _at(own, LIFTED)))
    )
    return _listed(left, cut, left_levels, "left"), _listed(right, b, right_levels, "right")


def overlapping(left: DataFrame, right: DataFrame, left_box: Box, right_box: Box, least: float = LEAST) -> DataFrame:
    """Pairs of rows whose boxes overlap or touch, each once; boxes with a missing bound meet none.

    The columns of both sides, which must differ in name (and not be called
    ``level``, ``kind``, ``cx`` or ``cy``).  A pair may meet in several cells
    and is kept in the one that holds the lower left corner of its overlap.
    No cell is narrower than ``least``.
    """
    rows = cell_rows(left, right, left_box, right_box, least)
    if rows is None:
        return left.join(right, F.lit(False))
    a, b, keys = [F.col(c) for c in left_box], [F.col(c) for c in right_box], ["level", "kind", "cx", "cy"]
    level = F.col("level")
    return (
        rows[0]
        # how many cells a row is listed in is unknown to the planner, which would broadcast them
        .join(rows[1].hint("merge"), keys)
        .where((a[0] <= b[2]) & (a[2] >= b[0]) & (a[1] <= b[3]) & (a[3] >= b[1]))
        .where((F.col("cx") == _place(F.greatest(a[0], b[0]), level)) & (F.col("cy") == _place(F.greatest(a[1], b[1]), level)))
        .drop(*keys)
    )
