"""DataFrame operators: parsing, enrichment, filters, statistics, maintenance."""
