"""Data sources: the framed container for encoded streams."""

from .container import ContainerSource, read_container

__all__ = ["ContainerSource", "read_container"]
