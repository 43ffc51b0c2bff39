"""The steps of a blueprint, each a plain function from DataFrames to a DataFrame."""
