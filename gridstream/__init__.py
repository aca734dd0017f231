"""Wide-area electrical measurements on Spark: batch operators over long-form
time series, their streaming twins, and the queries that use them."""
