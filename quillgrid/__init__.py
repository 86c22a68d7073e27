"""Word counts, planar outliers, k-center clustering and frequent items as Spark jobs.

Every operator takes and returns DataFrames; none creates a session, prints,
or keeps state of its own.
"""
