"""DuckDB statements that state the expected result of every registered query.

They follow the definitions directly (event-level windows, ranking, EXISTS) and
share no code with the library, so agreement says something about both.
"""
