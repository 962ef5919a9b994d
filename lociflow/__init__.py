"""A Spark-native engine for genomic sequence and genotype data."""
