"""Registered jobs over the fixture tables and their SQL oracles."""
