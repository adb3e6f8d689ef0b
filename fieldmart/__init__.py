"""Field-sales and crop-risk analytics on Spark DataFrames.

Layers: raw CSV -> Bronze -> Silver -> Gold -> mart, plus business queries,
data-quality reports and Structured Streaming variants.  Every operator is a
``DataFrame -> DataFrame`` function for use with ``df.transform``.
"""
