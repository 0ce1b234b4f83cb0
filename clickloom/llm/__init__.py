"""Operations for large text corpora: ten operators and their queries.

Nothing outside this package imports it.  Each module holds one operator with a
general interface; :mod:`clickloom.llm.queries` derives the registered queries.

Functions of this package travel to executors by value, so that these need not
have the package installed.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
