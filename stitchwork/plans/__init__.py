"""Jobs, table stand-ins and the query catalog with its reference SQL."""
