"""Screening-profile analytics as Spark DataFrame operators."""

from platewise.roles import Roles

__all__ = ["Roles"]
