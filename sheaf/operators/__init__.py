"""DataFrame operators on records, cards, pages and links."""
