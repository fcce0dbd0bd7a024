"""Multi-sensor time-series analytics on Spark.

Every operator is a function from DataFrame to DataFrame.  Rows follow the
``readings`` schema (:mod:`telluria.schema`) unless an operator says otherwise.
"""
