"""The registered queries, each with the SQL that must agree with it."""
