"""A Spark-native engine for pairwise genetic relatedness."""
