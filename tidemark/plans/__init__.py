"""Registered queries, by family, each with DuckDB SQL where SQL can express it.

Conditions on ids modulo a number give rows of the stored tables a role (a fixture or a wanted
match, a signal or a candidate); every row takes part in the role it has.
"""
