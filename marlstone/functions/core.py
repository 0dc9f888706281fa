"""What the function modules share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often ``body`` names it.

    A Column that is named several times is copied into the plan each time, which grows without
    bound when such functions are nested; a lambda's variable is not.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))
