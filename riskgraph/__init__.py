"""A PySpark engine for strictly-prior features, entity graphs, decisions and audit trails."""
