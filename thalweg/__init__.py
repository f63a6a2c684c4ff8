"""Thalweg: river and watershed analytics as Spark jobs.

Every operator is a plain function from DataFrames to a DataFrame.  Nothing
here owns a session: the caller's session, catalog and settings are used.
"""

import sys

from pyspark import cloudpickle

# Functions handed to mapInPandas and the data source travel to the executors
# with the task, so a cluster needs no installed copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
