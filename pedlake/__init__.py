"""Family-genomics analytics on Spark: cohort operators and data-quality operators over DataFrames."""
