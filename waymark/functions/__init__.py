"""Part of waymark; see the README for the map of modules."""
