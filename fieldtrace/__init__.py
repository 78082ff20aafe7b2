"""Spark operators for observation records of marked individuals."""
