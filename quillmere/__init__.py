"""A Spark-native engine for conversation-history search, analytics and training-data preparation."""
