"""Spark-native reading, measuring and decoding of mainframe fixed-width extracts described by COBOL copybooks."""
