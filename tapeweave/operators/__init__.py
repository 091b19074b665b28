"""Time-series operators: DataFrame in, DataFrame out."""
