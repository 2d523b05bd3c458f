"""DataFrame operators that turn semi-structured documents and event streams into clean, private, shareable data."""
