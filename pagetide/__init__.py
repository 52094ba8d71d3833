"""Feed analytics on Spark: ingestion, deduplication and coverage of syndicated pages."""

import sys

from pyspark import cloudpickle

# Executors need no copy of this package: the few UDFs travel with the plan.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
