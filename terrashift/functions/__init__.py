"""Column functions: from columns to a column, no shuffle, no Python at run time."""
