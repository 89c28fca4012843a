"""corpusmill: set-oriented document retrieval and grounded-answer analytics on Spark.

Every operator takes DataFrames and returns DataFrames; a batch of questions is
a DataFrame, so one job answers all of them.
"""

__version__ = "0.1.0"
