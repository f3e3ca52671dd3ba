"""Operators for training-data pipelines; nothing else in the library imports them.

Task code of this subpackage travels with the job, so executors need numpy,
pyarrow and the tokenizer libraries but not this package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
