"""Vector expressions on ``array<float>`` columns."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


def squared_norm(vector: Column) -> Column:
    return F.aggregate(
        vector, F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double")
    )


def has_bad_value(vector: Column) -> Column:
    """A null, NaN or infinite component."""
    inf = F.lit(float("inf"))
    return F.exists(
        vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == inf)
    )


def round_half_up(values, digits: int):
    """Numpy counterpart of SQL ``round``: half-way cases move away from zero."""
    unit = 10.0**digits
    # Adding zero turns -0.0 into 0.0.
    return np.copysign(np.floor(np.abs(values) * unit + 0.5) / unit, values) + 0.0
