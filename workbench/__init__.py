"""The given test tables as domain tables, the registered queries and their SQL."""
