"""srcplan: source-code and code-change analytics expressed as Spark DataFrames."""
