"""End-to-end plans: cycle table, cohort study, operations."""
