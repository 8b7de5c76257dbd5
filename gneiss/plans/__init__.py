"""From text to plans: filters, schemas and the catalog of tables."""
