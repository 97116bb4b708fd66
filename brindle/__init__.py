"""brindle: a PySpark-native engine for stepwise belief-monitoring tables."""
