"""Spark-native schema intelligence: field catalogs, concept registries, schema review and data-quality checks."""
