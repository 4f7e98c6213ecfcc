"""Anomaly analytics for panels of many time series, written as Spark jobs."""

from tidepanel.session import build_session, materialize

__all__ = ["build_session", "materialize"]
