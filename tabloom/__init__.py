"""tabloom: profile, screen, prepare, fit and explain wide outcome tables on Spark."""
