"""Spark-native cohort characterization over clinical event tables."""

from cohortry.session import prepare, session
from cohortry.sources.cdm import Cdm

__all__ = ["Cdm", "prepare", "session"]
