"""Discourse-corpus analytics as Spark DataFrame operators.

Every operator is a function ``op(frame(s), *, params) -> DataFrame``: lazy, free of
global state and of driver-side loops over data.
"""

__version__ = "0.1.0"
