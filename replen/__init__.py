"""replen: retail replenishment analytics as PySpark DataFrame operators."""
