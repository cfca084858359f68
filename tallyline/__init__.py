"""tallyline: operational reconciliation and case control on Spark DataFrames."""

__version__ = "0.1.0"
