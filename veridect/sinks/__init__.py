"""Writers for predictions, reports, configs and snapshots."""
