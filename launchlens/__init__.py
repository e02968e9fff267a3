"""Product-launch analytics on Spark.

Every public function takes DataFrames or Columns and returns DataFrames or
Columns, so a whole workflow stays one lazy Spark plan until it is written.
"""
