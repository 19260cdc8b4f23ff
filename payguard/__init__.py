"""Accounts-payable controls as set-oriented Spark jobs."""
