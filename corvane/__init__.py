"""Retrieval analytics on Spark: every operator is a DataFrame plan in which queries are rows and ranks are columns.

functions/  column expressions (text, vectors, clean-up, fusion scores)
sources/    readers and writers (pages, JSON lines, tables, chat logs)
operators/  relational building blocks (chunking, top-k, graph, communities, quotas, metrics)
plans/      composite retrieval and evaluation plans
streaming/  optional incremental forms
"""
