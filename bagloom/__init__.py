"""Comprehension queries, array loops and generated SQL over Spark DataFrames."""

__all__ = ["Session", "debug", "debug_all", "explain", "function", "m", "monoid", "q", "qs", "s", "stream", "v", "value"]


def __getattr__(name: str):
    """The surface is loaded when it is used, so that Python workers don't load it."""
    if name in __all__:
        from bagloom import api

        return getattr(api, name)
    raise AttributeError(name)
