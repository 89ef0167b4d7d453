"""Spark jobs over sparse contact maps, signal tracks, intervals and rearrangement graphs."""
