"""DataFrame operators: parsing, chunking, search, evaluation, agent."""
