"""Ticket-sales analytics as lazy Spark DataFrames."""

from turnstile.filters import Filters
from turnstile.frame import MetricUnavailable, Tickets

__all__ = ["Filters", "MetricUnavailable", "Tickets"]
