"""Column to column: each function takes and gives Spark columns, and stays inside the JVM."""
