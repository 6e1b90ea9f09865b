"""molspark: molecular and training-data analytics on PySpark."""
