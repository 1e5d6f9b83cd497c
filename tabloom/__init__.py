"""Spark-native tabular machine-learning analytics."""

import sys

from pyspark import cloudpickle

# Functions sent to the workers travel with their code, so workers need not have the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

from tabloom.session import durable, session  # noqa: E402

__all__ = ["durable", "session"]
