"""Cohort measurement and paired inference as Spark jobs."""
