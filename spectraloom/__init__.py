"""Spark-native spectral text shortening and text analytics.

``optimize`` shortens one text, ``compress`` a DataFrame of them; the steps between are in
``operators`` (relational), ``functions`` (columns), ``plans``, ``sources`` and ``streaming``.
"""

from importlib import import_module

#: Public names and their modules, imported on first use so that Python workers load no more than they run.
_HOME = {"Options": "kernel", "Result": "kernel", "optimize": "kernel", "compress": "compress", "compress_relational": "compress", "register": "compress", "staged": "compress"}
__all__ = sorted(_HOME)


def __getattr__(name: str) -> object:
    if name not in _HOME:
        raise AttributeError(name)
    return getattr(import_module(f"spectraloom.plans.{_HOME[name]}"), name)
