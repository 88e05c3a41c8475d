"""Column-level helpers: no DataFrame, no action, JVM-side expressions only."""
