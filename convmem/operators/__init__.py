"""DataFrame operators of the conversation memory."""
