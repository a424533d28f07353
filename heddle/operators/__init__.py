"""Operators on form data: error lists, option search, constraints, record updates and keyed lookups."""
