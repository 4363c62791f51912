"""Query plans over the driver tables: fixture views, registered queries and
their DuckDB oracles, and the end-to-end listing chain."""
