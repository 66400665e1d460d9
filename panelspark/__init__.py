"""panelspark: vintage-aware panel data on Spark DataFrames."""

import sys

from pyspark import cloudpickle

# Task functions travel by value, so executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

from panelspark.session import build_session  # noqa: E402

__all__ = ["build_session"]
