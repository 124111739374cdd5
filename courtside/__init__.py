"""Competition results as Spark tables: normalise, merge, number, translate, search and report."""
