"""Sources: driver tables, derived stand-in tables, results/events/job readers."""
