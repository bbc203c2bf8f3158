"""Documents, dashboards and their delivery."""
