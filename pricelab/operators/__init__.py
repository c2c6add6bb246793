"""DataFrame -> DataFrame operators (cleaning, roll-ups, elasticity, segments, scenarios)."""
