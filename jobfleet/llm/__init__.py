"""Operators for preparing language-model training data.

Nothing else in the library imports this package. Each module holds one operator;
``queries`` applies them to the benchmark tables and ``oracle`` has the SQL.

Functions and classes of this package travel to the executors inside the job, which
therefore need no copy of it.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
