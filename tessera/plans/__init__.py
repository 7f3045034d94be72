"""The query catalogue over the test tables, with SQL for each query that SQL can express."""
