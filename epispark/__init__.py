"""Exposure-response analytics on panel data, and corpus operators, as Spark jobs."""
