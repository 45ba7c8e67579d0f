"""Column functions: semirings, exact rationals, planar geometry."""
