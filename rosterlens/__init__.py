"""Profile a population of respondents (models) from the answers they gave to shared questions.

Every operator takes and returns DataFrames; nothing here keeps a table on the driver.
"""
