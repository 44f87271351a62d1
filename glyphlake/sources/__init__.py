"""Dictionary records, line messages, page payloads and HTML as tables."""
