"""Reading and writing field snapshots and trajectories."""
