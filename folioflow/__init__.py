"""Document analytics on Spark: text repair, layout, tables, rasters, stores and quotas."""
