"""Ready-made queries over the shared test tables, and the SQL they must equal."""
