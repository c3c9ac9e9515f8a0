"""scrivener — corpus-scale text correction on Spark.

Text tables (or streams) go in; corrected lines, rejected rows, run counts and
quality reports come out.  Every stage is a ``DataFrame -> DataFrame`` function
built from Spark SQL expressions, joins, aggregations and windows; only the
optional user-model step (``operators.generate``) leaves the JVM, through an
Arrow-batched ``mapInPandas``.
"""

from scrivener.session import get_session, checkpoint_dir

__all__ = ["get_session", "checkpoint_dir"]
