"""Studies: several operators wired into one job."""
