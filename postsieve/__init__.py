"""postsieve: a Spark-native engine for triage of customer mail and text corpora."""

__version__ = "0.1.0"
