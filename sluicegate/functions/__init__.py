"""Column expressions: row hashing, hash uniforms, p-value tails."""
