"""Operators for large training corpora; nothing outside this package and corpus_pipeline.py imports it."""

import sys

from pyspark import cloudpickle

# Functions that run on executors travel with the code they use, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
