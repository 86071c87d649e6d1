"""nearname: look-alike domain analytics for DNS lookup logs, written as Spark jobs.

Every function takes DataFrames (or Columns) and returns DataFrames (or Columns), so the
jobs stay lazy and Catalyst sees one plan from scan to result.
"""
