"""flowframe: Spark-native preparation and auditing of ordered event and flow records."""
