"""rowlore: tabular retrieval as Spark DataFrame operators.

Files become row-level records, records get a derived column catalog, and both
are queried with structured filters, exact cosine top-k, or the two together.
"""

import sys

from pyspark.cloudpickle import register_pickle_by_value

from rowlore.model import DecodeOptions, FuzzyMatch

# Functions travel to Python workers by value: executors need no installed copy of the package.
register_pickle_by_value(sys.modules[__name__])

__all__ = ["DecodeOptions", "FuzzyMatch"]
