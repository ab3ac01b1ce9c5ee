"""Column functions and driver-side numerics."""
