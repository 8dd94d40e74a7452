"""A PySpark-native engine for budget-aware evidence retrieval and the analytics around it."""
