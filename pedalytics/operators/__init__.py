"""DataFrame -> DataFrame operators: staging, marts, checks."""
