"""loomspark: a PySpark-native engine for versioned document collections."""
