"""Column-to-column functions; every one stays inside the JVM."""
