"""Features from relational composition: units with coordinates and covariates, items observed in them with weights."""
