"""Operators for training-data pipelines: de-duplication, packing, quality rules,
fingerprints, licence scans, tokenizing, WARC derivatives and personal data.

Nothing else in the library imports this subpackage.
"""

import sys

from pyspark import cloudpickle

# Functions sent to Python workers travel with their code, so executors need not have
# the library on their path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
