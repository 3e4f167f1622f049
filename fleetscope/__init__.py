"""Fleet analytics as PySpark jobs: dependency graphs, change risk, claims,
identity, alarms, retention, cache statistics and migration checks."""
