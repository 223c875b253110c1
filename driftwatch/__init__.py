"""driftwatch: data-quality checks for recurring tabular snapshots on Spark.

Every check is a DataFrame -> DataFrame operator built from Catalyst
expressions; the suite unions them into one findings table and one metrics
table.
"""

__version__ = "0.1.0"
