"""Corporate-group mapping on PySpark: registers, ownership trees, matching and serving queries."""
