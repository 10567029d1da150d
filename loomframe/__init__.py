"""loomframe: DataFrame operators for governed data on Spark."""

from loomframe.session import configure

__all__ = ["configure"]
