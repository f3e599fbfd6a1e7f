"""Functions that run on executors travel by value, so that executors need no copy of this package."""

from __future__ import annotations

import sys

from pyspark import cloudpickle


def ship(module_name: str) -> None:
    cloudpickle.register_pickle_by_value(sys.modules[module_name])
