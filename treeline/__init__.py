"""Code-graph analytics on Spark: source trees, diffs, traces and coverage as tables."""
