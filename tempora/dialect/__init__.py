"""The query dialect: words, syntax and statements."""
