"""Column expressions; all but one stay inside the JVM."""
