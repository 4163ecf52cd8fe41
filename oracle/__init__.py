"""Independent DuckDB SQL twins of the registered queries (test oracle)."""
