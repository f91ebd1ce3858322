"""Where a case is written."""
