"""Site-planning analytics on Spark."""
