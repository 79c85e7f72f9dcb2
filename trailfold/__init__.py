"""trailfold — behavioural trace analytics as Spark DataFrame jobs.

Every public operator is a plain function ``DataFrame -> DataFrame`` (or a
few DataFrames in, one out).  Nothing here collects data to the driver;
the only actions are the ones the caller triggers.
"""

from trailfold.session import get_session, checkpoint_dir  # noqa: F401
