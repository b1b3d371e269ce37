"""Composite plans: the eight analyses, the finance derivations, the experiment binder."""

from . import reports
from .experiment import Experiment

__all__ = ["Experiment", "reports"]
