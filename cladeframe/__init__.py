"""PySpark-native engine for alignment-free placement of sequences on a rooted tree."""
