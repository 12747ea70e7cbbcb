"""proofgrain: document evidence at scale, as PySpark DataFrame operators.

Every operator takes and returns DataFrames keyed by packet, form and field, so one
job serves any number of packets.  See README.md for the layout.
"""

import sys as _sys

from pyspark import cloudpickle as _cloudpickle

# The small Python helpers travel to the executors inside the job, so workers need no
# installed copy of this package.
_cloudpickle.register_pickle_by_value(_sys.modules[__name__])
