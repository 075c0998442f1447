"""docscore: document-intelligence analytics as PySpark DataFrame transformations."""
