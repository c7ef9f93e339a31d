"""tallyloom: a PySpark-native ledger analytics engine."""
