"""Training-data pipeline operators (tokens, decontamination, near copies,
classifiers, language models, sharding, quality, secrets, toxicity).

Nothing else in the library imports this subpackage.  Functions that run in
Spark's Python workers are shipped by value, so executors need no copy of the
package on their path.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
