"""hotleaf: analytics over split JSON documents on PySpark."""
