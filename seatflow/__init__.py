"""seatflow: batch and streaming analytics for reservation data on Spark.

Operators take DataFrames (plus plain settings) and return DataFrames; nothing
is pulled through the driver.  See README.md for the catalogue.
"""

import sys as _sys

from pyspark import cloudpickle as _cloudpickle

# Python folds and stateful handlers travel to the workers by value, so the
# package need not be installed on executors (a cluster may still ship it
# with --py-files; both work).
_cloudpickle.register_pickle_by_value(_sys.modules[__name__])

from seatflow.session import build_session, ensure_checkpoint_dir  # noqa: E402

__all__ = ["build_session", "ensure_checkpoint_dir"]
