"""Training-data operators: ten corpus operators built on the DataFrame API.

Nothing outside this subpackage imports it; ``queries.py`` lists its queries.
"""
