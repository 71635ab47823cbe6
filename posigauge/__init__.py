"""posigauge: Spark transforms that compare two testing channels over time.

Every public function takes and returns DataFrames or Columns; nothing runs
until the caller asks for an action, except for the model fits, which are
iterative by nature and say so.
"""
