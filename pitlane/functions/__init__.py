"""Column functions and small driver-side statistics."""
