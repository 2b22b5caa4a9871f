"""shelfloom: a Spark-native engine for cleaning very large file collections."""
