"""Column functions: text, instructions, sequence kernels, command strings."""
