"""A PySpark-native analytics engine for modelling studies; see README.md."""
