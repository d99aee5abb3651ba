"""Spark analytics over mined source-code history.

Facts exported from many repositories (commits, detected refactorings, changed
files, line reports, issue pages) go in as tables; every operator is a plain
``DataFrame -> DataFrame`` function with the project as a grouping key, so all
projects run in one Spark job.
"""
