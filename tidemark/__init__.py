"""Event-time windows, watermarks and late data on PySpark DataFrames."""

from tidemark.operators.windows import WindowSpec, sliding, tumbling

__all__ = ["WindowSpec", "sliding", "tumbling"]
