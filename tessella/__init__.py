"""PySpark-native engine for text, lexicon and document data."""
