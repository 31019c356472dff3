"""Analytics for labelled longitudinal tables on Spark DataFrames."""

import sys

from pyspark import cloudpickle

# Ship this package's Arrow helpers with the job, so executors need no install.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
