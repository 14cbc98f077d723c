"""Event-sourced registry: commands in, outcomes, journal and records out."""
