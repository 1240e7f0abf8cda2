"""Named queries over the test tables: what ``__spark_entry__.py`` registers."""
