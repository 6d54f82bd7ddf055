"""Column expressions over DNA strings. Everything here stays inside the JVM."""
