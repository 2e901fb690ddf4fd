"""presswork: news and document enrichment as Spark jobs.

Column functions live in ``presswork.functions``, DataFrame operators in
``presswork.operators``, readers and writers in ``presswork.sources``,
composed plans (daily report, daily run, registered queries) in
``presswork.plans`` and the incremental ingest in ``presswork.streaming``.
Library code never creates a session; it works on the caller's.
"""

import sys

from pyspark import cloudpickle

# Functions of this package travel to the executors by value: these need not have it installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
