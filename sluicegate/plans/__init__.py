"""End-to-end compositions: gated release, drift monitor, run matrix."""
