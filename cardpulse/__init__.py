"""cardpulse: credit-card portfolio lifecycle analytics as Spark DataFrame functions.

Every public operator takes and returns ``pyspark.sql.DataFrame`` objects; the
work is declared with the DataFrame API so Catalyst/AQE choose the physical plan.
"""

import sys

from pyspark import cloudpickle

from cardpulse.session import get_session, checkpoint_dir

# Functions sent to executors carry their own code, so Python workers need not have this
# package on their path (a driver started from any folder works).
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__all__ = ["get_session", "checkpoint_dir"]
