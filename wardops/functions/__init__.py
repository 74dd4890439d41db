"""Column expressions: time, money and text.  All JVM-side."""
