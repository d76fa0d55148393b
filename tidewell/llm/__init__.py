"""Operators for training data of language models; nothing else in the library imports them.

Functions that run in tasks are sent to the executors by value, so executors need no copy of this
package; what is broadcast is plain data for the same reason.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
