"""rankspark: candidate ranking and evaluation as Spark DataFrame jobs.

Sub-packages:

* ``sources``   – readers/writers for response tables, item feeds, rankings, and the
                  fixture views built over the driver tables;
* ``functions`` – column expressions (text, arrays, quantisation);
* ``operators`` – DataFrame -> DataFrame operators (prepare, folds, ranking, ensemble,
                  metrics, profile, prompts, scoring, fitting, tuning);
* ``plans``     – the query catalogue (Spark query + DuckDB oracle SQL per operator);
* ``streaming`` – Structured Streaming scoring of arriving item files.
"""

import sys

from pyspark import cloudpickle

# Functions that run in tasks are pickled by value: workers need not find this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__all__ = ["__version__"]
__version__ = "0.2.0"
