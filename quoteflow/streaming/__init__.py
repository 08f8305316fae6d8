"""The same flow on Structured Streaming: dedup with state, a store that survives faults, progress."""

import sys

from pyspark import cloudpickle

# Ship the functions that run inside tasks with the query, so that executors need no installation.
cloudpickle.register_pickle_by_value(sys.modules["quoteflow"])
