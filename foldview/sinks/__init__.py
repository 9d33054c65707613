"""Publishers."""
