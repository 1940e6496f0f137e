"""Frequency summaries of keyed streams, expressed as Spark DataFrames.

Every operator takes DataFrames and returns a lazy DataFrame. A stream is any table with a
``key`` and an integer ``weight`` (``seq`` too where arrival order matters); a sketch is a
table of counters, so building is a grouped sum, merging is a union plus a grouped sum, and
querying is a broadcast join.
"""

from tallyweave.spec import SketchSpec, sketch_params_from_memory

__all__ = ["SketchSpec", "sketch_params_from_memory"]
