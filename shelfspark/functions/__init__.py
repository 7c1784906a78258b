"""Column-to-column functions; everything here stays inside the JVM unless its name ends in ``_udf``."""
