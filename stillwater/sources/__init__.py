"""Tables and record files as DataFrames."""
