"""Column builders; everything here stays in the JVM unless a docstring says otherwise."""
