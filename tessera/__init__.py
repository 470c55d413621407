"""tessera: a Spark-native engine for sample catalogues and binary containers."""
