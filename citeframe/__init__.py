"""citeframe: a PySpark-native engine for traceable document facts."""
