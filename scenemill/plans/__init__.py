"""The given tables, shaped into the operators inputs."""
