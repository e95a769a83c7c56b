"""lorecast: a Spark-native analytics engine for narrative and text corpora."""

__version__ = "0.1.0"
