"""Fixed values of the rule sets: word lists, thresholds, class lists, phrases."""
