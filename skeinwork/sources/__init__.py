"""Reading tables, keeping snapshots, and adapters of outside shapes to the model."""
