"""lodestack: a Spark-native engine for document retrieval, document graphs and corpus analytics."""
