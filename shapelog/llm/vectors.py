"""What the vector operators share: which vectors take part, and blocks of Arrow lists."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F


def sound(column: str = "embedding", zero: bool = True):
    """Whether a vector is there, has components, all of them finite, and (unless ``zero``) not all zero."""
    broken = F.exists(column, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    good = (F.size(column) > 0) & ~broken
    if not zero:
        good = good & F.exists(column, lambda x: x != 0)
    return F.coalesce(good, F.lit(False))


def by_length(column):
    """Row numbers of an Arrow list or binary column by the length of its rows."""
    sizes = np.array([len(x) if x.is_valid else 0 for x in column], np.int64)
    for n in np.unique(sizes):
        yield int(n), np.flatnonzero(sizes == n)
