"""shiftlens: explain why a business metric moved between two periods, on Spark.

Every operator takes and returns DataFrames. The sub-packages are:

- ``sources``   - table loading, document folders, chunk store, run log tables, profiles
- ``plans``     - the semantic model (tables, join paths, dimensions), metric specs and the
                  composed investigation
- ``operators`` - metric layer, change analysis, anomaly scan, retrieval, grounding, audit, ad hoc
- ``functions`` - column-level helpers (safe ratios, sort keys, canonical JSON)
"""

import sys

from pyspark import cloudpickle

# Functions of this package that run inside tasks travel with the task itself, so executors need
# neither the package on their path nor the driver's working folder.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__version__ = "0.1.0"
