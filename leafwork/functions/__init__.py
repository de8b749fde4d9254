"""Column expressions. Everything here stays inside Catalyst; nothing is a Python UDF."""
