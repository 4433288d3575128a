"""Activity-track telemetry analytics as DataFrame-to-DataFrame operators."""
