"""Every operator as a query over the test tables, with independent SQL to check it."""
