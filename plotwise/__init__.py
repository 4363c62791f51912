"""plotwise: Spark-native listing analytics.

Every operator is a function ``DataFrame -> DataFrame`` (or a Column
expression) whose column names, dictionaries and thresholds are
arguments; nothing runs an action except model fits and explicit sinks.
"""

from plotwise.session import get_spark, checkpoint_dir  # noqa: F401

__all__ = ["get_spark", "checkpoint_dir"]
