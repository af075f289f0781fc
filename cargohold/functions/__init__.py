"""Column builders: plain built-in expressions that stay inside whole-stage codegen."""
