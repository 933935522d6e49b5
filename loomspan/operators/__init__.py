"""Panel operators: DataFrames and parameters in, a DataFrame out; no action inside unless a docstring says so."""
