"""Plans: operators assembled into the source's flows and the query registry."""
