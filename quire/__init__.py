"""quire: document analytics as Spark DataFrame transformations."""
