"""Set-at-a-time operators over the chat views."""
