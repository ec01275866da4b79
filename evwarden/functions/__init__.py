from evwarden.functions.members import bool_member, event_time, members, number_member, string_member

__all__ = ["bool_member", "event_time", "members", "number_member", "string_member"]
