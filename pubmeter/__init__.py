"""Publication analytics on Spark: matching, topics, coverage and representation statistics.

Every public function takes and returns DataFrames or Columns, so a whole study is one lazy plan.
"""
