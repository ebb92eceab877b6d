"""Seed plans, catalogs and the registered queries."""
