"""Column-level functions; every one returns a Column and stays in the JVM."""
