"""Evidence search over long videos, and corpus operators, as Spark DataFrame queries."""
