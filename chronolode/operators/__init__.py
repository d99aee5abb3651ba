"""DataFrame operators. None of them collects, and none uses a Python UDF."""
