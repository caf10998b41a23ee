"""Quantity reconciliation of building inventories, expressed as Spark DataFrames.

Every table carries ``job_id``: one Spark job reconciles any number of
(listing, plan) pairs at once.
"""
