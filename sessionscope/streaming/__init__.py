"""Streams: the collection loop, its side tables, carried memory, the session load."""

import sys

from pyspark import cloudpickle

# The state machines travel with the job, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
