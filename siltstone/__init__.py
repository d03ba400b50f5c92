"""Content identity, inventory, record and release analytics as Spark DataFrame operators."""
