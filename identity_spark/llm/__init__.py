"""Operations of a training-data pipeline: sharding, tokens, filters, joins and searches over text tables.

Nothing outside this folder imports it; the registered queries are in :mod:`identity_spark.llm.queries`.
"""
