"""Query catalogues: the queries and their SQL twins."""
