"""End-to-end jobs: from raw tables to features, player tables and scores."""
