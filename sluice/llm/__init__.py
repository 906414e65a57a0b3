"""Operations of a large-scale training-data pipeline, each in a module of its own."""

import sys

from pyspark import cloudpickle

# Executors need no copy of this package: its task functions travel with the plan.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
