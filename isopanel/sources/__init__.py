"""Reading observation files, the indicator catalogue and the place dimension."""
