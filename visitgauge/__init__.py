"""Screening analytics as Spark DataFrame operators.

Every public function takes and returns DataFrames or Columns; nothing here
runs a row loop on the driver.
"""
