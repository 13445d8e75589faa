"""gristmill: a PySpark-native engine that turns source corpora into training data."""
