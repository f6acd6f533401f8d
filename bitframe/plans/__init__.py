"""Expressions over machine integers, their domains and the plans that check them."""
