"""The operators: DataFrame in, DataFrame out, keyword parameters."""
