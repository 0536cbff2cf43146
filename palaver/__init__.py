"""Conversation analytics and training-data preparation as Spark jobs.

Every public function takes DataFrames and returns a lazy DataFrame; nothing in the
library reads the clock, draws random numbers or collects rows of unbounded number.
"""

__version__ = "0.1.0"
