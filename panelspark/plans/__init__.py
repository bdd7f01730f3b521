"""Compositions of operators into the tables that later steps share."""
