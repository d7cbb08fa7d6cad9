"""ledgerkit: consolidate and analyse financial ledgers as Spark jobs."""

from __future__ import annotations

import sys

__version__ = "0.1.0"


def ship_by_value(module_name: str) -> None:
    """Pickle the functions of ``module_name`` by value when Spark sends them to
    Python workers, so executors need no installed copy of this package."""
    from pyspark import cloudpickle

    cloudpickle.register_pickle_by_value(sys.modules[module_name])
