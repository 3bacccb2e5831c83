"""Evidence engine for company filings, written as Spark DataFrame operators.

Subpackages
-----------
functions   Column in, Column out: text, amounts, periods, vectors, statistics.
operators   DataFrame in, DataFrame out: retrieval, claims, printed numbers, ranking, bootstrap.
sources     readers with declared schemas and quarantine, canonical writers, index tables.
plans       whole jobs: index filings, build labelled questions, run a split, report, regression.
streaming   Structured Streaming jobs over arriving questions and request logs.
catalog     the registered queries and the SQL each is compared with.
"""

import sys

from pyspark import cloudpickle

# The few Python functions run inside tasks travel with the job, so executors need no copy of
# this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
