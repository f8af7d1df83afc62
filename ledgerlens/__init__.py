"""Business intelligence, data quality and model evaluation as Spark jobs.

Every operator takes DataFrames and returns a DataFrame.  Nothing here moves
data rows through the driver: the driver only ever sees schemas, catalogs of
columns and single rows of bounds.
"""

from ledgerlens.session import get_session

__all__ = ["get_session"]
