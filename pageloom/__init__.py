"""Document-layout, conversion-tracking and training-data analytics on Spark."""
