"""chainloom: a PySpark-native analytics engine for feature-rich scientific tables keyed by entity id."""
