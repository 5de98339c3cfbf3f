"""Operations of a large training-data pipeline, each written as Spark jobs.

Nothing else in the library imports this subpackage.
"""
