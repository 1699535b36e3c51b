"""strandloom: a Spark-native sequence-mapping and corpus-processing engine."""
