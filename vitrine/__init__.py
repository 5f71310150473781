"""Merchant visual-evidence risk analytics as Spark DataFrame operators."""

from .session import local_session, prepare

__all__ = ["local_session", "prepare"]
