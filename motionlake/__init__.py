"""Motion-tracking analytics on PySpark: generic time-series, event, join and report operators."""
