"""Support-conversation analytics as composable PySpark DataFrame operators."""
