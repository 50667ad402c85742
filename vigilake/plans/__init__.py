"""Whole queries over the test tables, and the SQL each must agree with."""
