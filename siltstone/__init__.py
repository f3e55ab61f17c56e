"""siltstone: retrieval, memory-state and telemetry analytics as plain Spark DataFrame operators."""
