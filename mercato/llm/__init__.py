"""Training-data operators: one module per operator, all over Spark DataFrames.

Every operator takes DataFrames, reads only the columns it names (extra columns
pass through or are ignored, whatever they are called) and returns a DataFrame.
`queries.py` holds the registered queries and their SQL twins.
"""
