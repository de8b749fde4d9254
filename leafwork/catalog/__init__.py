"""Example workspace over the generated tables, and the registered queries with their SQL twins."""
