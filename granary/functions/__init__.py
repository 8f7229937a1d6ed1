"""Elementwise functions by name, for expressions and expression strings."""

from granary.functions.elementwise import REGISTRY

__all__ = ["REGISTRY", *sorted(REGISTRY)]


def __getattr__(name: str):
    try:
        return REGISTRY[name]
    except KeyError:
        raise AttributeError(name) from None
