"""Index-event cohort analytics as DataFrame -> DataFrame functions on Spark SQL."""
