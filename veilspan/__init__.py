"""veilspan: a PySpark-native engine that finds, resolves, replaces and restores sensitive spans."""
