"""talentgrid: candidate-document pipeline and recruiting analytics on Spark.

Every operator takes DataFrames and returns a DataFrame (or takes columns and
returns a Column), so Catalyst sees one declarative plan from the scan to the
sink.  See README.md for the map of modules.
"""

from talentgrid.session import get_session

__all__ = ["get_session"]
