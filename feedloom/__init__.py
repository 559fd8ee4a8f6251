"""Feed harvesting, publishing and reporting as plain Spark DataFrame code.

All timestamps are instants and every day boundary is a UTC day unless a zone is
passed in, so sessions must run with ``spark.sql.session.timeZone = UTC``
(:func:`feedloom.session.prepare` sets it). The clock is always an argument
called ``now``; nothing in the package reads the wall clock by itself.
"""

__version__ = "0.1.0"
