"""Where order lines come from, and where predictions go."""
