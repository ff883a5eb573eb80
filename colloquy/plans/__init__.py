"""The registered queries of the chat engine, with their SQL."""
