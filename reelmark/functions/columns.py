"""Column expressions that several operators share. All are built-in Spark functions."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..constants import BOX_PAD, FAILURE, FRAME_WIDTH, FULL_MOVE, SUCCESS, TAG_THRESHOLD

__all__ = ["any_word", "filled", "first_filled", "in_box", "known", "label_from_name", "label_of", "mean_present", "nan_to_null", "norm", "numeric", "pad_box", "ramp", "slow_tag", "split_prompts", "tag_above", "tag_from", "to_camera", "vector_minus"]


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def label_from_name(name: Column | str) -> Column:
    """success or failure by the suffix of a task name, else null."""
    name = _col(name)
    return F.when(name.endswith("_success"), SUCCESS).when(name.endswith("_failure"), FAILURE)


def label_of(label: Column | str, name: Column | str) -> Column:
    """A label of the two known ones, else the task name's."""
    return F.coalesce(F.when(_col(label).isin(SUCCESS, FAILURE), _col(label)), label_from_name(name))


def filled(c: Column | str) -> Column:
    """A string, null where it is empty."""
    return F.nullif(_col(c), F.lit(""))


def first_filled(*cols: Column | str, default: str = "") -> Column:
    """The first string that is neither null nor empty."""
    return F.coalesce(*map(filled, cols), F.lit(default))


def numeric(c: Column | str, default: float) -> Column:
    """A number, the default where it is null or 0."""
    return F.coalesce(F.nullif(_col(c).cast("double"), F.lit(0.0)), F.lit(default))


def nan_to_null(c: Column | str) -> Column:
    """NaN means missing: comparisons with it must not hold."""
    return F.nanvl(_col(c).cast("double"), F.lit(None).cast("double"))


def known(condition: Column) -> Column:
    """A condition, false where it is unknown."""
    return F.coalesce(condition, F.lit(False))


def tag_above(score: Column | str, threshold: Column | float = TAG_THRESHOLD) -> Column:
    """success if the score is above the threshold; null without a score."""
    score = _col(score)
    return F.when(score > threshold, SUCCESS).when(score.isNotNull(), FAILURE)


def tag_from(score: Column | str, threshold: Column | float = TAG_THRESHOLD) -> Column:
    """success if the score reaches the threshold; null without a score."""
    score = _col(score)
    return F.when(score >= threshold, SUCCESS).when(score.isNotNull(), FAILURE)


def slow_tag(statistic: Column | str, late: Column | str, peak: Column | str) -> Column:
    """The statistic that a dataset is tagged by: max or, for anything else, late."""
    return F.when(_col(statistic) == "max", _col(peak)).otherwise(_col(late))


def mean_present(*cols: Column | str) -> Column:
    """The mean of those that are not null; null if none is."""
    cols = tuple(map(_col, cols))
    total = sum((F.coalesce(c, F.lit(0.0)) for c in cols), F.lit(0.0))
    n = sum((c.isNotNull().cast("int") for c in cols), F.lit(0))
    return F.when(n > 0, total / F.nullif(n, F.lit(0)))


def norm(*cols: Column | str) -> Column:
    return F.sqrt(sum((_col(c) * _col(c) for c in cols), F.lit(0.0)))


def vector_minus(a: Column | str, b: Column | str) -> Column:
    return F.zip_with(_col(a), _col(b), lambda x, y: x - y)


def pad_box(x0: Column, y0: Column, x1: Column, y1: Column, pad: float = BOX_PAD) -> Column:
    """A box as (x0, y0, x1, y1), widened on each side by a share of its size.

    The edges are taken from the centre and the half size, both at nine decimals: corners carry the rounding of the sums they
    came from, and it would decide about points on an edge.
    """
    x, y = F.round((x0 + x1) / 2, 9), F.round((y0 + y1) / 2, 9)
    w, h = F.round((x1 - x0) * (0.5 + pad), 9), F.round((y1 - y0) * (0.5 + pad), 9)
    return F.struct((x - w).alias("x0"), (y - h).alias("y0"), (x + w).alias("x1"), (y + h).alias("y1"))


def in_box(x: Column | str, y: Column | str, box: Column | str) -> Column:
    """Whether a point is in a box, edges included; null if either is missing."""
    box = _col(box)
    return _col(x).between(box["x0"], box["x1"]) & _col(y).between(box["y0"], box["y1"])


def ramp(move: Column, present: Column, full: float = FULL_MOVE, share: float = 0.5) -> Column:
    """0 to 1 with the distance moved, 0 if the object isn't there at the end."""
    return F.when(present >= share, F.least(F.lit(1.0), move / full)).otherwise(0.0)


def split_prompts(c: Column | str) -> Column:
    """The prompts of a comma-separated list, trimmed, without empty ones."""
    return F.filter(F.transform(F.split(_col(c), ","), lambda x: F.trim(x)), lambda x: x != "")


def any_word(c: Column | str, words: Iterable[str]) -> Column:
    """Whether one of the words is part of a string, whatever its case; a null string holds none."""
    text = F.coalesce(F.lower(_col(c)), F.lit(""))
    out = F.lit(False)
    for w in words:
        out = out | F.contains(text, F.lit(w))
    return out


def to_camera(xyz: Column | str, transform: Column | str) -> Column:
    """A point of an arm's frame in the camera's: R^-1 (p - t) for the arm-from-camera transform [R t; 0 1].

    R is inverted by cofactors, so it need not be a rotation; null without a transform or with a singular one.
    """
    p, m = _col(xyz), _col(transform)
    r = [[F.get(F.get(m, i), j) for j in range(3)] for i in range(3)]
    d = [F.get(p, i) - F.get(F.get(m, i), 3) for i in range(3)]

    def cofactor(i: int, j: int) -> Column:
        a, b, c, e = (i + 1) % 3, (i + 2) % 3, (j + 1) % 3, (j + 2) % 3
        return r[a][c] * r[b][e] - r[a][e] * r[b][c]

    det = sum((r[0][j] * cofactor(0, j) for j in range(3)), F.lit(0.0))
    return F.when(det != 0, F.array(*[sum((cofactor(j, i) * d[j] for j in range(3)), F.lit(0.0)) / F.nullif(det, F.lit(0.0)) for i in range(3)]))
