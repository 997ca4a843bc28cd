"""Panel factor analytics on Spark: bars, rolling and cross-sectional operators, factor sets, quality and risk tables."""

import sys

from pyspark import cloudpickle

# The few Python helpers that run inside tasks travel with the job, so executors need no install of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

from barley.operators import FactorSet, Slice, Track  # noqa: E402,F401
