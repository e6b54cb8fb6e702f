"""Column functions of the domain."""

from .market import arrival_number, day, hour, microprice, minute, signed_qty, squared_return

__all__ = ["arrival_number", "day", "hour", "microprice", "minute", "signed_qty", "squared_return"]
