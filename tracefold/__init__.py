"""tracefold: session-log analytics as Spark DataFrame plans."""

from .model import Index

__all__ = ["Index"]
