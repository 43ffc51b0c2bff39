"""Whole blueprints and runs over several of them."""
