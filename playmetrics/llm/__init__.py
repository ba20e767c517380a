"""Operators of a training-data pipeline over a table of documents.

Each module holds one operator with a general interface; ``queries`` applies them to the given
tables. Functions that run in Python workers travel with the job.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__.partition(".")[0]])
