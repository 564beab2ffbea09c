"""Test-table bindings: each operator bound to the given tables, beside the SQL that checks it."""
