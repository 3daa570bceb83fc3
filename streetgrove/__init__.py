"""Street-planting compliance analytics as Spark DataFrame transformations.

Every operator takes DataFrames keyed by ``site_id`` and returns a DataFrame, so one
job serves every street (and every plan variant) of a city at once.
"""
