"""Spark-native analysis and upkeep of a multi-tenant, replicated, versioned key-value dataset held as tables."""
