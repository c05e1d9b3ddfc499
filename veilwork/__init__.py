"""Spark-native detection and redaction of credentials and personal data in text."""
