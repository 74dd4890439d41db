"""Read queries: DataFrames and parameters in, DataFrame out, nothing collected."""
