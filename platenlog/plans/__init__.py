"""Whole jobs put together from the operators, and the session they run on."""
