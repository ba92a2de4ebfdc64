"""Road-network analytics as DataFrame operators: graph building, routing, spatial overlay and address search."""

import sys

from pyspark import cloudpickle

# Python functions that run on executors carry their code with them.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
