"""Entity resolution, cleaning, masking and data quality over DataFrames."""
