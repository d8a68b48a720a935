"""The registered queries, their inputs out of the test tables, and their oracles."""
