"""Column-level building blocks; every one returns a ``Column`` and stays in the JVM."""
