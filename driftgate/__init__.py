"""Spark operators for moving large tables between systems and proving the move right."""
