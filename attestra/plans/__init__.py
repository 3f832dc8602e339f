"""Registered queries."""

from attestra.plans import extra_queries, log_queries, record_queries, registered_queries, scoring_queries, site_queries, track_queries  # noqa: F401
from attestra.plans.registry import QUERIES, SQL


def all_queries():
    return QUERIES


def all_sql():
    return SQL
