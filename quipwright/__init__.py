"""quipwright: Spark-native operators for text corpora, ratings and their release."""

__version__ = "0.1.0"
