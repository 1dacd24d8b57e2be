"""Release-comparison analytics on Spark: supports, panels, score revisions, allocations and data checks."""
