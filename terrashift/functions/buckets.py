"""Classes of ratios, sizes, shapes and directions. Every threshold is a parameter."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Labels in their order.
RATE_LABELS = ("Much Slower", "Slower", "Similar", "Faster", "Much Faster")
LEVEL_LABELS = ("Much Lower", "Lower", "Similar", "Higher", "Much Higher")
LOW_RATE = "Low Rate"
OCTANTS = ("N", "NE", "E", "SE", "S", "SW", "W", "NW")
AREA_LABELS_6 = ("Smallest", "Small", "Medium-Small", "Medium", "Large", "Largest")
AREA_LABELS_5 = ("Smallest", "Small", "Medium", "Large", "Largest")


def ratio_bucket(ratio: Column, multiple: float = 4.0, low: float = 0.83, high: float = 1.2, labels: tuple[str, ...] = RATE_LABELS, null_label: str | None = None) -> Column:
    """Five classes: below 1/multiple, below ``low``, up to ``high``, up to ``multiple``, above."""
    usable = ratio.isNotNull() & ~F.isnan(ratio) & (F.abs(ratio) < F.lit(float("inf")))
    return (
        F.when(~usable, F.lit(null_label).cast("string"))
        .when(ratio < 1.0 / multiple, labels[0])
        .when(ratio < low, labels[1])
        .when(ratio <= high, labels[2])
        .when(ratio <= multiple, labels[3])
        .otherwise(labels[4])
    )


def shaking_bucket(ratio: Column, much_lower: float = 0.6, low: float = 0.83, high: float = 1.2, much_higher: float = 3.0) -> Column:
    return (
        F.when(ratio.isNull() | F.isnan(ratio), F.lit(None).cast("string"))
        .when(ratio < much_lower, LEVEL_LABELS[0])
        .when(ratio < low, LEVEL_LABELS[1])
        .when(ratio <= high, LEVEL_LABELS[2])
        .when(ratio <= much_higher, LEVEL_LABELS[3])
        .otherwise(LEVEL_LABELS[4])
    )


def rain_bucket(ratio: Column, similar: float = 1.1, higher: float = 1.5) -> Column:
    return (
        F.when(ratio.isNull() | F.isnan(ratio), F.lit(None).cast("string"))
        .when(ratio <= similar, LEVEL_LABELS[2])
        .when(ratio <= higher, LEVEL_LABELS[3])
        .otherwise(LEVEL_LABELS[4])
    )


def area_bucket(area: Column, bounds: tuple[float, ...] = (4.0, 4.5, 5.0, 5.5, 6.0), labels: tuple[str, ...] = AREA_LABELS_6) -> Column:
    """Classes of log10 of an area; ``Unknown`` for none or a negative one."""
    size = F.log10(F.when(area > 0, area))
    out = F.when(area.isNull() | F.isnan(area) | (area <= 0), F.lit("Unknown"))
    for bound, label in zip(bounds, labels, strict=False):
        out = out.when(size < bound, label)
    return out.otherwise(labels[len(bounds)])


def shape_class(axis_ratio: Column, slump: float = 2.5, earthflow: float = 4.5) -> Column:
    return (
        F.when(axis_ratio.isNull() | F.isnan(axis_ratio), "unknown")
        .when(axis_ratio < slump, "slump")
        .when(axis_ratio <= earthflow, "earthflow")
        .otherwise("complex")
    )


def is_elongate(axis_ratio: Column, least: float = 2.0) -> Column:
    return axis_ratio >= least


def compass_octant(angle: Column) -> Column:
    index = F.pmod(F.floor((F.pmod(angle, F.lit(360.0)) + 22.5) / 45).cast("int"), F.lit(8))
    return F.get(F.array(*[F.lit(o) for o in OCTANTS]), index)


def axis_class(angle: Column) -> Column:
    """EW or NS by the nearest axis; at equal distance the one with the smaller angle."""
    a = F.pmod(angle, F.lit(360.0))
    return F.when(((a > 45) & (a <= 135)) | ((a > 225) & (a < 315)), "EW").when(a.isNotNull(), "NS")


def expected_sign(aspect: Column, low: float = 10.0, high: float = 190.0) -> Column:
    """+1 where motion down that aspect comes towards the sensor, else -1."""
    return F.when(F.pmod(aspect, F.lit(360.0)).between(low, high), 1).when(aspect.isNotNull(), -1)


def mismatch_direction(expected: Column, observed: Column) -> Column:
    return (
        F.when((expected == -1) & (observed == 1), "expected_neg_observed_pos")
        .when((expected == 1) & (observed == -1), "expected_pos_observed_neg")
        .when(expected.isNotNull() & observed.isNotNull() & (expected != observed), "other")
    )


def boundary_distance(aspect: Column, low: float = 10.0, high: float = 190.0) -> Column:
    a = F.pmod(aspect, F.lit(360.0))
    return F.least(F.abs(a - low), F.abs(a - high))


def interval_arrow(low: Column, high: Column) -> Column:
    """How an interval lies to zero: ``up``, ``down``, or ``ns`` if it holds zero."""
    return F.when(low > 0, "up").when(high < 0, "down").when(low.isNotNull() & high.isNotNull(), "ns")
