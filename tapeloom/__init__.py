"""Panel analytics on Spark: keyed (instrument, date[, minute]) tables."""
