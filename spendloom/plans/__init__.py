"""Table builds and reports composed of the operators."""
