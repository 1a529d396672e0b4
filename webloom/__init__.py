"""webloom: Spark-native analysis of crawled web corpora."""

__version__ = "0.1.0"
