"""Training-data operators: filters, joins, index, archive, extraction and packing on Spark.

Nothing else in the library imports this folder.
"""
