"""Group-level analytics over longitudinal observations of several sources, on Spark."""
