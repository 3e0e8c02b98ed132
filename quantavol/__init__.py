"""quantavol: a Spark-native engine for quantising and analysing 16-bit image volumes."""
