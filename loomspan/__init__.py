"""Spark-first analytics for genotype matrices, linkage maps and the tables around them."""
