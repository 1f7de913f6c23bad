"""quarry: a Spark-native event analytics engine (query builder, versioned tables, detectors)."""
