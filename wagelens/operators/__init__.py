"""Generic DataFrame operators; tables, keys and measures are arguments."""
