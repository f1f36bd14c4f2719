"""Column expressions: everything here takes and returns Columns and stays in the JVM."""
