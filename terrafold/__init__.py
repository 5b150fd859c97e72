"""Property-market analytics as DataFrame-to-DataFrame functions on Spark."""
