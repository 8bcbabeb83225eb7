"""Recording quality control and trajectory datasets as Spark DataFrame functions."""
