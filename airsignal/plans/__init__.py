"""Query plans: input frames derived from the test tables, jobs, and the query registry."""
