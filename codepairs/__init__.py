"""Code-pair analytics on Spark: labelling, pairing, sampling, scoring and
embedding analysis of source-code records as DataFrame operators."""

import sys

from pyspark import cloudpickle

# Functions that run in Python workers travel with the job, so executors need no
# copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
