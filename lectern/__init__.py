"""Lectern: a Spark-native engine for collections of mixed documents.

Typed content blocks, chunks with page provenance, context windows, stores
with latest-wins merges, a document graph, retrieval and reporting, all as
``DataFrame -> DataFrame`` functions that Catalyst plans.
"""

import sys

from pyspark import cloudpickle

# Functions of this package travel to executors by value, so a cluster needs
# no installed copy of it.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__version__ = "0.1.0"
