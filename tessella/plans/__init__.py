"""Formulas and encoders: from a declaration to a plan."""
