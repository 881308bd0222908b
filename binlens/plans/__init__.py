"""Query plans: stand-in views over the driver tables and the registered query catalog."""
