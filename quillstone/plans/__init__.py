"""Driver-side plans: personas parsed from JSON and checked before anything runs."""
