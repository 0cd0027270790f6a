"""A PySpark-native analytics engine for operational telemetry."""
