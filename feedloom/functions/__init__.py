"""Column functions. All of them run inside the JVM."""
