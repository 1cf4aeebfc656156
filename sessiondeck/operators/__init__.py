"""Operators over the event table. All of a session's operators partition by `sid`, so one exchange serves a chain of them."""
