"""orbweave: entity intelligence analytics as Spark DataFrame transformations."""
