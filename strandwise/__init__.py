"""Spark-native analytics for nucleotide sequence collections: DataFrame in, DataFrame out."""
