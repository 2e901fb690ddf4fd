"""Operators for preparing language-model training data.

Nothing outside this subpackage imports it. ``presswork.llm.registry`` holds
the registered queries and their SQL.
"""

import sys

from pyspark import cloudpickle

# Functions of this subpackage travel to the executors by value: these may lack it on their import path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
