"""The array language: right-to-left expressions over vectors, compiled to DataFrames."""
