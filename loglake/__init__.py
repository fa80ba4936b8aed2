"""loglake: append-only commit logs as Spark tables."""
