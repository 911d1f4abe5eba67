"""leafmill: a Spark-native engine for page-structured document corpora."""
