"""Queries over the driver's tables and the SQL they are checked against."""

from . import (  # noqa: F401
    catering_checks,
    function_checks,
    menu_checks,
    payload_checks,
    promotion_checks,
    stream_checks,
)
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
