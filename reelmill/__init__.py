"""Spark-native medallion analytics for ratings-style data.

Bronze tables are typed at ingest, staging and silver clean them, gold holds the
data products.  Every model is a function ``DataFrame -> DataFrame``; Spark plans,
shuffles and executes the work.
"""
