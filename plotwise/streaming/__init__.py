"""Streaming reuse of the row-wise operators.

The reference has no streaming operator (no watermark, window or state),
so nothing stream-specific is built. The parsing expressions (2.5) and
batch scoring (V8) are row-wise Column expressions, so they apply to a
``readStream`` DataFrame unchanged; ``clean_listing_stream`` wires that up.
"""

from plotwise.streaming.rowwise import clean_listing_columns, clean_listing_stream  # noqa: F401
