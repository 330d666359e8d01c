"""Column expressions: scalar rules that run inside whole-stage codegen."""
