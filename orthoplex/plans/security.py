"""Who may see what: roles to model permission, row filters and hidden tables.

Roles are united: what any of a user's roles grants is granted.  Without an ``auth``
section everybody is an administrator; with one, a user whom no role names gets
nothing.
"""

from __future__ import annotations

from dataclasses import dataclass

from orthoplex.plans.model import Model, Role, User

ADMIN, READ, NONE = "administrator", "read", "none"


@dataclass(frozen=True)
class Access:
    """Of a table: full, filtered by an SQL predicate, or hidden."""

    kind: str  # full, filtered, hidden
    predicate: str = ""


FULL, HIDDEN = Access("full"), Access("hidden")


@dataclass(frozen=True)
class Grant:
    """What a user may do with a model."""

    permission: str
    roles: tuple[Role, ...] = ()

    def table(self, table: str) -> Access:
        if self.permission == ADMIN:
            return FULL
        if self.permission == NONE:
            return HIDDEN
        predicates, hidden = [], False
        for role in self.roles:
            if role.permission == NONE:
                continue
            entries = [t for t in role.tables if t.table == table]
            if any(t.metadata != NONE and not t.filter.strip() for t in entries) or not entries:
                return FULL
            hidden |= any(t.metadata == NONE for t in entries)
            predicates += [t.filter.strip() for t in entries if t.metadata != NONE]
        if predicates:
            return Access("filtered", predicates[0] if len(predicates) == 1 else " OR ".join(f"({p})" for p in dict.fromkeys(predicates)))
        return HIDDEN if hidden else FULL


def grant(model: Model, user: User | None) -> Grant:
    if model.auth is None:
        return Grant(ADMIN)
    if user is None:
        return Grant(NONE)
    names = {x for x in (user.name, *user.groups) if x}
    claimed = {r.lower() for r in user.roles}
    mine = tuple(r for r in model.roles if r.name.lower() in claimed or any(m in names for m in r.members))
    permissions = {r.permission for r in mine}
    return Grant(ADMIN if ADMIN in permissions else READ if READ in permissions else NONE, mine)
