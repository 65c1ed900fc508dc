"""DataFrame operators: quality, imputation, time series, triples, graph queries, embeddings."""
