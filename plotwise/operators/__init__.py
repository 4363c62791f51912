"""DataFrame -> DataFrame operators, one module per survey section."""
