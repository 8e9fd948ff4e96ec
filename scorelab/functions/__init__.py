"""Column -> Column building blocks (all JVM-side, inside whole-stage codegen)."""
