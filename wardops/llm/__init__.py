"""Operators for preparing training text and vectors; nothing else imports this package.

Functions that run inside tasks travel with the job, so executors need no copy of
the package on their Python path.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
