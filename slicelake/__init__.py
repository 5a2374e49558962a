"""slicelake: Spark-first processing of barcoded, slice-resolved sequencing data."""
