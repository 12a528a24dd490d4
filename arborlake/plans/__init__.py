"""How plans are run: scratch tables, numbering, and the catalogue of registered queries."""
