"""Typed frames and large-scale data processing as PySpark DataFrame plans."""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# functions of this package travel to the executors by value: nothing has to be installed there
cloudpickle.register_pickle_by_value(sys.modules[__name__])

from .frame import Frame, concat, join  # noqa: E402
from .series import Series  # noqa: E402
from .session import session  # noqa: E402
from .sources import read_csv, read_csv_mem, read_json, read_json_mem  # noqa: E402

NA, NAN = None, float("nan")

__all__ = ["NA", "NAN", "Frame", "Series", "concat", "join", "read_csv", "read_csv_mem", "read_json", "read_json_mem", "session"]
