"""Column functions: calendar, labelling, numeric cleaning and distribution tails."""
