"""webplan: web-analytics planning over a page corpus, as plain Spark DataFrame jobs."""
