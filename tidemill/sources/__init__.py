"""Sources: contracts, adapters, fixtures and the seam between files and Kafka."""
