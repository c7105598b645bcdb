"""Listening analytics as Spark DataFrame, SQL and ML plans."""

from earshot.plans.listening_log import ListeningLog

__all__ = ["ListeningLog"]
