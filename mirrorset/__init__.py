"""mirrorset: duplicate, near-duplicate and clip-in-source detection for media catalogs on Spark.

Every operator is a plain ``DataFrame -> DataFrame`` function that can be chained with
``df.transform``. Nothing here collects data to the driver.
"""
