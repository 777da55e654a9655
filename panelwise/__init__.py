"""Business-health analytics as plain DataFrame-in / DataFrame-out operators."""
