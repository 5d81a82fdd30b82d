"""A PySpark engine for working memory over text and code."""
