"""Every operator as a runnable query over the test tables, with its SQL oracle."""
