"""DataFrame operators: packets, flows, corpora, token examples, routing, metrics, synthesis."""
