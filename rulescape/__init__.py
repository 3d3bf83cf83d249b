"""Network-policy risk analytics as Spark DataFrame transformations."""
