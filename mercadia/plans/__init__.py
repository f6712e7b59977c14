"""Logical plans for the marts, the star schema and the reports."""
