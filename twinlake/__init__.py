"""twinlake: Spark-native duplicate, drift and clean-up analytics over file inventories."""

__version__ = "0.1.0"
