"""corpusloom: a Spark-native engine for analysing large bodies of text."""

__version__ = "0.1.0"
