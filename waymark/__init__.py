"""waymark: linear-referenced trail analytics and corpus preparation on Spark."""
