"""Analysis specs, their execution, and the catalogue of registered queries."""
