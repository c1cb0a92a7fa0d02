"""Named queries over the test tables, with the SQL that each must equal."""
