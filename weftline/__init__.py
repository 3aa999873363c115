"""weftline: similarity search over notebooks and tables, as Spark plans."""
