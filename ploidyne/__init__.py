"""ploidyne: a Spark-native engine for haplotype-aware copy-number analysis."""
