"""Registered query plans: each pairs a Spark builder with its oracle SQL."""

from netsieve.plans.catalog import QUERIES, ORACLE, FLAGSHIP

__all__ = ["QUERIES", "ORACLE", "FLAGSHIP"]
