"""Web and ecommerce behaviour analytics on Spark DataFrames.

``sources``    reading the nested event log, writing and reading tables
``functions``  column expressions (parameters, channels, rates, calendar)
``operators``  DataFrame building blocks (sessions, cohorts, shares)
``plans``      the tables, reports and checks built from them
"""
