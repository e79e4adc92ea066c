"""clipwave: Spark-native analytics for stimulation recordings and training corpora."""
