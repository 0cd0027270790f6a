"""Query languages compiled to DataFrames, reports and retention."""
