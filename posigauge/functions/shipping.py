"""Let Python workers run this package's functions without having it installed."""

import sys

from pyspark.cloudpickle import register_pickle_by_value


def ship_by_value(module_name: str) -> None:
    """Send the module's functions along with the task instead of by name."""
    register_pickle_by_value(sys.modules[module_name])
