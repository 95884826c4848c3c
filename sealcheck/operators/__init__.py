"""DataFrame operators of the posture engine."""
