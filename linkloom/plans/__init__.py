"""Named queries over the tables of a data directory, with equivalent SQL where there is one."""
