"""Part of the code-analytics engine."""
