"""Training-data operators: de-duplication, decontamination, quality, privacy, extraction, tokens.

Nothing else in the library imports this subpackage.  Its functions travel to
Python workers by value, so that executors need no copy of the repository.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
