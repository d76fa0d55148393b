"""Load plans: targets, state tables, jobs."""
