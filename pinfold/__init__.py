"""Version-pinned retrieval and data processing on Spark."""
