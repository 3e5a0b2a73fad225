"""Operators of a training-data pipeline over text, pages, chats and vectors."""
